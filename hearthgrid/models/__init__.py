"""Binary classifiers, walk-forward training and scoring."""
