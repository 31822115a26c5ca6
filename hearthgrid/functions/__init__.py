"""Column-level building blocks (no DataFrame-level work here)."""
