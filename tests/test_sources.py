import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tilesmith.functions import images
from tilesmith.operators import tiling
from tilesmith.operators import cohort
from tilesmith.sources import bags, files, slides
from tilesmith.streaming import ingest

from tests.backends import Bounded


def tree(root, *names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")


def test_discovery(spark, tmp_path):
    tree(tmp_path, "top.svs", "cls/a.b.svs", "cls/n.ndpi", "cls/deep/x.SVS", ".hid/q.svs", "cls/readme.txt")
    found = slides.checked(slides.discovered(spark, str(tmp_path)))
    assert {r.slide_name for r in found.collect()} == {"top", "a", "n"} and found.count() == 3
    tree(tmp_path, "cls/a.c.svs")
    with pytest.raises(ValueError, match="several slides"):
        slides.checked(slides.discovered(spark, str(tmp_path)))
    tree(tmp_path, "none/x.txt")
    with pytest.raises(FileNotFoundError):
        slides.checked(slides.discovered(spark, str(tmp_path / "none")))


def test_associated_images(spark):
    """Two images of a slide, none of a plain one, an error row where one can't be read; a column of the same name gives way."""
    df = spark.createDataFrame([("c/a.svs", "c"), ("c/broken.svs", "c"), ("c/plain.svs", "c")], "path string, class_dir string").selectExpr("*", "7 as width")
    rows = slides.associated_images(df, "tests.backends:Labelled").orderBy("path", F.col("image").asc_nulls_last()).collect()
    assert [(r.path, r.image, r.width, r.height) for r in rows] == [("c/a.svs", "label", 3, 2), ("c/a.svs", "macro", 1, 4), ("c/broken.svs", "label", 3, 2), ("c/broken.svs", None, None, None)]
    assert bytes(rows[0].pixels) == bytes([7]) * 18 and rows[3].error == "OSError: unreadable macro" and rows[0].class_dir == "c"
    assert slides.associated_images(df).count() == 0 == slides.associated_images(df.limit(0), "tests.backends:Labelled").count()


def test_tiles_are_read_filtered_and_stored(spark, tmp_path):
    df = spark.createDataFrame([("c/a.svs", "c", "a"), ("c/broken.svs", "c", "broken")], "path string, class_dir string, slide_name string")
    known = slides.described(df).withColumn("objective", tiling.objective_power())
    grid = tiling.tile_geometry(tiling.tile_grid(tiling.level_plan(known, 40, (0,))))
    tiles = slides.read_tiles(grid)
    rows = tiles.collect()
    assert len(rows) == grid.count()
    assert {r.slide_name for r in tiling.failures(tiles).collect()} == {"broken"}
    own = [r for r in rows if r.slide_name == "a"]
    assert all(len(r.pixels) == 224 * 224 * 3 for r in own)
    kept = slides.read_tiles(grid.where("slide_name = 'a'"), threshold=15)
    assert {(r.col, r.row) for r in kept.collect()} == {(r.col, r.row) for r in own if r.edge > 15} == {(r.col, r.row) for r in tiling.foreground(tiles).where("slide_name = 'a'").collect()}
    assert 0 < kept.count() < len(own)
    out = str(tmp_path / "tiles")
    files.write_tiles(kept, out)
    assert tiling.pending(grid.where("slide_name = 'a'"), spark.read.parquet(out)).count() == len(own) - kept.count()


def test_tile_source(spark):
    slides.register(spark)
    df = spark.read.format("tilesmith_tiles").options(paths="c/a.svs;c/broken.svs", depth=1, tile_size=64, block=2).load()
    assert df.rdd.getNumPartitions() > 2
    w, h, _ = slides.SyntheticBackend().describe("c/a.svs")
    assert df.where("path = 'c/a.svs' and error is null").count() == np.prod(tiling.grid_size(w, h, 1, 64))
    assert df.where("path = 'c/broken.svs' and error is null").count() == 0
    with pytest.raises(Exception, match="needs openslide"):
        spark.read.format("tilesmith_tiles").options(paths="c/a.svs", backend="openslide").load().count()


def test_images_round_trip(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (2, 8, 8, 3), dtype=np.uint8)
    tiles = spark.createDataFrame([("c", "s", i, 0, bytearray(p.tobytes())) for i, p in enumerate(px)], "class_dir string, slide_name string, col int, row int, pixels binary")
    bags.write_bags(tiles, str(tmp_path / "bags"), 8)
    back = {(r.class_dir, r.slide_name, r.col, r.row): r.pixels for r in files.patch_images(spark, str(tmp_path / "bags")).collect()}
    assert back == {("c", "s", i, 0): p.ravel().tolist() for i, p in enumerate(px)}
    assert files.image_count(spark, str(tmp_path / "bags"), ("png",)) == 2


def test_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿Extra,ESKD,Mors,Mors_year\n1,Yes,Nei,2001\n2,,Ja,x\n", encoding="utf-8")
    got = files.csv(spark, str(tmp_path / "c.csv"), files.COHORT).collect()
    assert [tuple(r) for r in got] == [("Yes", "Nei", 2001, None, None), (None, "Ja", None, None, None)]
    (tmp_path / "r.csv").write_text("patient_fnr,patient_id\n01,k\n")
    assert files.register(spark, str(tmp_path / "r.csv")).collect()[0].patient_fnr == "01"
    (tmp_path / "r.xlsx").write_bytes(b"")
    with pytest.raises((ImportError, ValueError)):
        files.register(spark, str(tmp_path / "r.xlsx"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", "s", [0.03125, -1.0], 1), ("c", "s", [2.0, 3.5], 1), ("d", "t", [0.0, 0.5], 0)], "class_dir string, slide_name string, features array<float>, label int")
    files.write_features(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("class_dir = 'c'").count() == 2
    files.export_features(df, str(tmp_path / "csv"), 2)
    (part,) = (tmp_path / "csv/class_dir=c/slide_name=s").glob("*.csv")
    assert sorted(part.read_text().split()) == sorted(["0,1,label", "0.0312,-1.0000,1", "2.0000,3.5000,1"])
    files.export_features(df, str(tmp_path / "tree"), 2, label=None)
    assert next((tmp_path / "tree/class_dir=d/slide_name=t").glob("*.csv")).read_text().split()[0] == "0,1"
    files.write_manifest(df.select(F.col("slide_name").alias("path"), "label"), str(tmp_path / "m"))
    assert next((tmp_path / "m").glob("*.csv")).read_text().split()[0] == "0,label"
    files.write_list(df.select("slide_name"), str(tmp_path / "l"))
    assert next((tmp_path / "l").glob("*.csv")).read_text().split()[0] == "slide_name"


def test_stream_takes_each_slide_once(spark, tmp_path):
    tree(tmp_path / "in", "cls/a.svs", "cls/b.ndpi", "cls/no.txt")
    args = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state")
    assert ingest.ingest(spark, *args) == 2
    tree(tmp_path / "in", "cls/c.svs")
    assert ingest.ingest(spark, *args) == 3 == ingest.ingest(spark, *args)
    assert {r.slide_name for r in spark.read.parquet(args[1]).collect()} == {"a", "b", "c"}


def test_damaged_images_keep_their_row(spark, tmp_path):
    d = tmp_path / "c" / "s"
    d.mkdir(parents=True)
    (d / "1_2.png").write_bytes(b"not an image")
    (r,) = files.patch_images(spark, str(tmp_path)).collect()
    assert (r.col, r.row, r.pixels, r.width, r.error) == (1, 2, None, None, "not an image")


def test_a_cohort_with_its_own_outcome(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ESKD,Mors,Mors_year,Transplant,Dialysis,RRT_or_death,First_event_RRT_death\nYes,Nei,2001,No,No,1,3\n")
    (r,) = cohort.cohort(files.csv(spark, str(tmp_path / "c.csv"), files.COHORT_WITH_OUTCOME)).collect()
    assert (r.ESKD, r.Death, r.RRT_or_death, r.First_event_RRT_death) == (1, 0, 1, 3)


def test_tiles_of_bounded_slides_begin_at_the_offset(spark):
    whole, n = slides.SyntheticBackend(), 32
    grid = spark.sql(f"select 'a/b.svs' as path, 0 as depth, 1 as col, 0 as row, {n} as x0, 0 as y0, {n} as w, {n} as h, 100 as offset_x, 60 as offset_y")
    (r,) = slides.read_tiles(grid, tile_size=n).collect()
    assert r.error is None and bytes(r.pixels) == whole.region("a/b.svs", 0, n + 100, 60, n, n).tobytes()


def test_the_tile_source_reads_only_what_is_asked_for(spark, tmp_path):
    slides.register(spark)
    paths = [str(tmp_path / f"{n}.svs") for n in "ab"]
    table = str(tmp_path / "described")
    slides.described(spark.createDataFrame([(p,) for p in paths], "path string"), "tests.backends:Counting").write.parquet(table)

    def tiles(**options):
        return spark.read.format("tilesmith_tiles").options(described=table, tile_size=64, block=3, **{"depths": "0,1"} | options).load()

    every = tiles().collect()
    want = sorted((r.path, r.depth, r.col, r.row) for r in every)
    sizes = {p: slides.SyntheticBackend().describe(p)[:2] for p in paths}
    assert want == sorted((p, d, c, r) for p in paths for d in (0, 1) for cols, rows in [tiling.grid_size(*sizes[p], d, 64)] for c in range(cols) for r in range(rows))

    def asked():
        out = [f"{p} {line}" for p in paths if (tmp_path / f"{p}.regions").exists() for line in (tmp_path / f"{p}.regions").read_text().split("\n")[:-1]]
        for p in paths:
            (tmp_path / f"{p}.regions").unlink(missing_ok=True)
        return sorted(out)

    for options, test in (({"rows": ":3"}, lambda p, d, c, r: r < 3), ({"depths": "1", "rows": "1:3", "cols": "4:"}, lambda p, d, c, r: d == 1 and 1 <= r < 3 and c >= 4), ({"rows": "0:0"}, lambda *_: False)):
        got = sorted((r.path, r.depth, r.col, r.row) for r in tiles(backend="tests.backends:Counting", **options).collect())
        assert got == [t for t in want if test(*t)]
        assert asked() == sorted(f"{p} {d} {c * 64} {r * 64}" for p, d, c, r in got)
    # the same with a grid: what a filter leaves out is not read
    grid = tiling.tile_geometry(tiling.tile_grid(spark.read.parquet(table).withColumn("depth", F.lit(1)), 64), 64).where("row < 2 and col = 3")
    assert sorted(f"{r.path} 1 192 {r.row * 64}" for r in slides.read_tiles(grid, "tests.backends:Counting", 64).collect()) == asked()
    # planned from the table: described once, when it was made
    assert all((tmp_path / f"{p}.described").read_text() == "x\n" for p in paths)
    edges = sorted(r.edge for r in every)
    assert sorted(r.edge for r in tiles(above=edges[50]).collect()) == [e for e in edges if e > edges[50]]
    # filters of one DataFrame don't get in one another's way
    df = tiles()
    both = df.where("depth = 0").union(df.where("depth = 1"))
    assert sorted((r.path, r.depth, r.col, r.row) for r in both.collect()) == want
    with pytest.raises(Exception, match="is no range"):
        tiles(rows="3").count()


def test_the_tile_source_begins_at_the_bounds(spark, tmp_path):
    slides.register(spark)
    table = str(tmp_path / "described")
    own = slides.described(spark.createDataFrame([("s.svs",), ("s.svs",)], "path string"), "tests.backends:Bounded")
    assert own.count() == 2  # repeated paths stay two rows
    known = tiling.bounded(tiling.with_bounds(own.limit(1)))
    assert [known.first()[c] for c in ("offset_x", "offset_y", "width", "height")] == [64, 32, 300, 800]
    known.write.parquet(table)
    for options in ({"described": table}, {"paths": "s.svs"}):
        df = spark.read.format("tilesmith_tiles").options(backend="tests.backends:Bounded", tile_size=100, **options).load()
        rows = {(r.col, r.row): bytes(r.pixels) for r in df.collect()}
        assert set(rows) == {(c, r) for c in range(3) for r in range(8)}
        assert rows[1, 2] == Bounded().region("s.svs", 0, 100, 200, 100, 100, 64, 32).tobytes()
    whole = spark.read.format("tilesmith_tiles").options(backend="tests.backends:Bounded", tile_size=100, paths="s.svs", bounds="false").load()
    assert whole.count() == 80


def test_a_backend_must_exist():
    with pytest.raises(ValueError, match="unknown backend"):
        slides.opened("nothing")


def test_bounds_of_properties(spark):
    key = "openslide.bounds-"
    rows = [({f"{key}x": "5", f"{key}y": " 6 ", f"{key}width": "70", f"{key}height": "80"}, None), ({f"{key}x": "a"}, None), ({f"{key}y": "-1"}, None), ({f"{key}height": "0"}, "before"), ({}, None), (None, None)]
    df = spark.createDataFrame([(i, 100, 90, *r) for i, r in enumerate(rows)], "i int, width int, height int, properties map<string,string>, error string")
    got = [(r.offset_x, r.offset_y, r.width, r.height, r.error) for r in tiling.bounded(tiling.with_bounds(df)).orderBy("i").collect()]
    plain = (0, 0, 100, 90)
    assert got == [(5, 6, 70, 80, None), (*plain, "bad bounds x: a"), (*plain, "bad bounds y: -1"), (*plain, "before"), (*plain, None), (*plain, None)]


def test_partitions_of_tiles_do_not_grow_with_the_slides(tmp_path):
    """Each task costs more than a few tiles do, so many slides fill partitions and don't add to them."""
    n = 6000
    pq.write_table(pa.table({"path": [f"{i}.svs" for i in range(n)], "width": pa.array([700] * n, pa.int32()), "height": pa.array([600] * n, pa.int32())}), tmp_path / "described.parquet")
    options = {"described": str(tmp_path / "described.parquet"), "depths": "1,2", "tile_size": "128", "rows": ":2", "cols": "1:3"}
    plans = [slides.TileReader(options | more).partitions() for more in ({}, {"partitions": "50"}, {"partitions": "50", "tiles": "2000"})]
    assert 900 < len(plans[0]) <= 1000 and 45 < len(plans[1]) <= 50 and len(plans[2]) == 18
    for plan in plans:
        assert sorted((b.path, b.depth, b.rows) for p in plan for b in p.blocks) == sorted((f"{i}.svs", d, range(2)) for i in range(n) for d in (1, 2))


def test_tiles_leave_the_worker_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(slides, "BATCH_BYTES", 5 * 64 * 64 * 3)
    reader = slides.TileReader({"paths": "a.svs;b.svs", "tile_size": "64", "tiles": "100000"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert {b.num_rows for b in batches[:-1]} == {5} and batches[-1].num_rows <= 5
    keys = [(r["path"], r["row"], r["col"]) for b in batches for r in b.to_pylist()]
    want = [(p, r, c) for p in ("a.svs", "b.svs") for w, h, _ in [slides.SyntheticBackend().describe(p)] for r in range(-(-h // 64)) for c in range(-(-w // 64))]
    assert keys == want


def test_synthetic_pixels_and_edge_values_are_those_of_the_plain_formulas():
    backend, rng = slides.SyntheticBackend(), np.random.default_rng(0)
    for path, depth, x, y, w, h, ox, oy in (("a.svs", 0, 5, 7, 90, 31, 64, 32), ("b.svs", 2, 50, 17, 33, 64, 3, 5), ("c.svs", 1, 0, 0, 300, 300, 0, 0)):
        width, height, _ = backend.describe(path)
        yy, xx = (np.mgrid[y : y + h, x : x + w] + 0.5) * 2**depth + np.array([oy, ox])[:, None, None]
        inside = ((xx - width / 2) / (0.4 * width)) ** 2 + ((yy - height / 2) / (0.4 * height)) ** 2 < 1
        want = np.stack([np.where(inside, 60 + (xx // 8 + yy // 8) % 2 * 120 + 10 * b, 255) for b in range(3)], -1)
        assert (backend.region(path, depth, x, y, w, h, ox, oy) == want).all()
    for x in (rng.integers(0, 256, (9, 7, 3), np.uint8), np.full((5, 5), 255, np.uint8), rng.integers(0, 2, (6, 6, 1), np.uint8) * np.uint8(255)):
        bands, total = np.atleast_3d(x).astype(int), 0
        for i, j in np.ndindex(x.shape[:2]):
            inner = 0 < i < x.shape[0] - 1 and 0 < j < x.shape[1] - 1
            total += (np.clip(9 * bands[i, j] - bands[i - 1 : i + 2, j - 1 : j + 2].sum((0, 1)), 0, 255) if inner else bands[i, j]).sum()
        assert images.edge_value(x, 8) == total / bands.shape[2] / 64
