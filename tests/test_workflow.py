from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hearthgrid.catalog import views
from hearthgrid.plans import decide
from hearthgrid.plans.workflow import Workflow

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_the_whole_workflow_over_stored_tables(spark, tmp_path):
    w = Workflow(spark, str(tmp_path), views.CONFIG)
    w.prepare(
        views.readings(spark, str(DATA)), views.prices(spark, str(DATA)), views.weather(spark, str(DATA))
    )
    w.predict()
    table = w.recommend(0.2, 0.2)
    devices = {r.device for r in table.select("device").distinct().collect()}
    assert devices == set(views.CONFIG.shiftable_devices)
    # every device and day is either recommended on or has a reason
    days = w.table("profiles").select(*decide.KEY)
    assert table.count() + w.table("errors").count() == days.count()
    assert table.where(F.col("recommendation").isNotNull()).count() > 0
    grid = w.grid_search((0.2, 0.6), (0.2, 0.6))
    assert grid.count() == 4
    one = grid.where("activity_threshold = 0.2 AND usage_threshold = 0.2").first()
    assert one.n_recommendations == table.where(F.col("recommendation").isNotNull()).count()
    scores = w.agent_scores().collect()
    assert {(r.agent, r.metric) for r in scores} == {("activity", "auc"), ("usage", "auc"), ("load", "mse")}
    folders = list(Path(tmp_path / "grid").glob("_bucket=*"))
    assert folders and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
