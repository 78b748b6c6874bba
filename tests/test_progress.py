import pytest
from pyspark.resource import TaskResourceRequests
from pyspark.sql import functions as F
from tilesmith.operators import features, tiling
from tilesmith.operators.progress import Ledger
from tilesmith.sources import slides


def test_the_ledger_counts_what_the_job_did(spark, tmp_path):
    grid = spark.createDataFrame([(p, i, 0) for p in ("c/a.svs", "c/broken.svs") for i in range(20)], "path string, col int, row int").selectExpr("*", "0 as depth", "32 * col as x0", "160 as y0", "32 as w", "32 as h")
    ledger = Ledger(spark, "job 1")
    tiles = ledger.watch(slides.read_tiles(ledger.watch(grid, "planned"), tile_size=32), "read")
    kept = ledger.watch(tiles.where("error is null and col % 2 = 0"), "kept")
    kept.write.parquet(str(tmp_path / "tiles"))
    got = {r.step: (r.place, r.n_rows, r.n_failed, r.n_dropped) for r in ledger.table().collect()}
    plain = slides.read_tiles(grid, tile_size=32)
    failed, n = tiling.failures(plain).count(), spark.read.parquet(str(tmp_path / "tiles")).count()
    assert got == {"planned": (0, 40, 0, None), "read": (1, 40, failed, 0), "kept": (2, n, 0, 40 - n)} and failed == 20 and n == 10
    ledger.write(str(tmp_path / "ledger"))
    other = Ledger(spark, "job 2")
    other.watch(spark.range(7).withColumn("x", F.col("id")), "all", F.col("x") > 4).count()
    other.write(str(tmp_path / "ledger"))
    rows = spark.read.parquet(str(tmp_path / "ledger"))
    assert rows.count() == 4 and rows.where("job = 'job 2'").select("n_rows", "n_failed").first() == (7, 2)
    with pytest.raises(ValueError, match="watched already"):
        other.watch(spark.range(1), "all")


def test_a_model_stage_alone_has_the_profile(spark):
    """A local master has no profiles, so embedded falls back there; with one given, only the model's node has it."""
    asked = TaskResourceRequests().cpus(1).resource("gpu", 0.5)
    assert features.placed(spark, asked) is None
    df = spark.createDataFrame([(1, [1.0, 2.0])], "inst int, pixels array<double>")
    assert features.embedded(df, features.LinearEmbedder(2, 3), profile=features.placed(spark, asked)).count() == 1
    profile = features.ResourceProfileBuilder().require(asked).build
    plan = features.embedded(df.repartition(2), features.LinearEmbedder(2, 3), profile=profile)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Profile:") == 1 and "gpu" in next(x for x in text.split("\n") if "Profile:" in x) and "MapInArrow" in next(x for x in text.split("\n") if "Profile:" in x)
