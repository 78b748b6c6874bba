"""Hand-made cases of FIXTURES.md."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tilesmith.config import FeatureConfig, TilingConfig, renamed
from tilesmith.functions import ids, images, paths, vectors
from tilesmith.operators import cohort, features, manifest, mil, tiling


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_level_plan(spark):
    rows = [("a", 1000, 700, 40.0), ("b", 1000, 700, 20.0), ("c", 1000, 700, 10.0), ("d", 1000, 700, 30.0)]
    df = spark.createDataFrame(rows, "slide_name string, width int, height int, objective double")
    got = {(r.slide_name, r.level): (r.depth, r.mag) for r in tiling.level_plan(df, 20, (0, 1)).collect()}
    assert got == {("a", 0): (1, 20), ("a", 1): (2, 10), ("b", 0): (0, 20), ("b", 1): (1, 10), ("c", 1): (0, 10), ("d", 0): (0, 30), ("d", 1): (1, 15)}
    order = {(r.slide_name, r.level): r.position for r in tiling.level_plan(df, 20, (0, 1)).collect()}
    assert order["a", 1] == 1 and order["a", 0] == 2
    assert tiling.level_plan(df, 20, (50,)).count() == 0


def test_objective(spark):
    df = spark.sql("select map('openslide.objective-power', '40') p union all select map('x', 'y') union all select null")
    assert [r[0] for r in df.select(tiling.objective_power("p")).collect()] == [40.0, 40.0, 40.0]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.sql("select map('openslide.objective-power', '40.0') p").select(tiling.objective_power("p")).collect()


def test_grid_and_geometry(spark):
    df = spark.createDataFrame([("a", 1000, 700, d) for d in (0, 1, 2)], "slide_name string, width int, height int, depth int")
    n = {r.depth: r.n for r in tiling.tile_grid(df).groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 20, 1: 6, 2: 2}
    assert [tiling.grid_size(1000, 700, d) for d in (0, 1, 2)] == [(5, 4), (3, 2), (2, 1)]
    g = {(r.col, r.row): (r.x0, r.y0, r.w, r.h) for r in tiling.tile_geometry(tiling.tile_grid(df.where("depth = 0")), 224, 3).collect()}
    assert g[0, 0] == (0, 0, 227, 227) and g[1, 1] == (221, 221, 230, 230) and g[4, 3] == (893, 669, 107, 31)
    assert sum(w * h for _, _, w, h in ((r.x0, r.y0, r.w, r.h) for r in tiling.tile_geometry(tiling.tile_grid(df.where("depth = 0"))).collect())) == 700_000
    b = spark.sql("select 'a' slide_name, 1000 width, 700 height, struct(10 as x, 20 as y, 300 as width, 200 as height) bounds union all select 'b', 50, 60, null")
    assert [tuple(r) for r in tiling.bounded(b).select("offset_x", "offset_y", "width", "height").collect()] == [(10, 20, 300, 200), (0, 0, 50, 60)]


def test_tree(spark):
    low = spark.createDataFrame([("s", 1, 2), ("s", 9, 9)], "slide_name string, col int, row int")
    high = spark.createDataFrame([("s", c, r) for c in range(2, 5) for r in (4, 5)] + [("t", 2, 4)], "slide_name string, col int, row int")
    assert {(r.col, r.row) for r in tiling.children_kept(high, low, 2).collect()} == {(2, 4), (2, 5), (3, 4), (3, 5)}
    tree = {tuple(r) for r in tiling.patch_tree(low, high, 2).collect()}
    assert tree == {("s", 1, 2, c, r) for c in (2, 3) for r in (4, 5)} | {("s", 9, 9, None, None)}
    assert tiling.patch_tree(low, high, 2, drop_childless=True).count() == 4


def test_edges():
    white = np.full((224, 224, 3), 255, np.uint8)
    noise = np.random.default_rng(0).integers(0, 256, (224, 224, 3), dtype=np.uint8)
    assert images.edge_value(white, 224) == pytest.approx(4.5332, abs=1e-4)
    assert images.edge_value(noise, 224) > 100 > 15 > images.edge_value(white, 224)
    assert images.edges(np.arange(4).reshape(2, 2)).tolist() == [[0, 1], [2, 3]]


def test_pixels(spark):
    px = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert images.chw(px).shape == (3, 4, 4)
    assert images.resized(px, 4, 4) is px and images.resized(np.full((9, 7, 3), 9, np.uint8), 4, 5).tolist() == np.full((4, 5, 3), 9).tolist()
    got = one(spark, images.centre_crop(F.lit(px.ravel().tolist()), 4, 4, 2, 3), images.normalised(F.lit([255, 0, 51]), (0.5, 0.5, 0.5), (0.5, 0.5, 0.25)))
    assert got[0] == px[1:3, 1:3].ravel().tolist() and got[1] == pytest.approx([1, -1, -1.2])


def test_fusion(spark):
    h, lo = F.lit([1.0, 2.0]), F.lit([4.0, 8.0])
    assert one(spark, vectors.fused(h, lo, "fusion"), vectors.fused(h, lo, "cat")) == ([2.0, 4.0], [1.0, 2.0, 4.0, 8.0])
    with pytest.raises(ValueError, match="unknown fusion"):
        vectors.fused(h, lo, "mean")


def test_labels(spark):
    df = spark.createDataFrame([("class_0",), ("class_1_foo",), ("other",)], "d string")
    assert [r[0] for r in df.select(paths.class_label("d")).collect()] == [0, 1, -1]
    bad = spark.createDataFrame([("class_x",)], "d string")
    assert bad.select(paths.class_label("d", strict=False)).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(paths.class_label("d")).collect()
    both = {r.class_dir: (r.label_ordinal, r.label_parsed) for r in manifest.with_labels(spark.createDataFrame([("b",), ("a",), ("class_7",), ("a",)], "class_dir string")).collect()}
    assert both == {"a": (0, -1), "b": (1, -1), "class_7": (2, 7)}


def test_paths(spark):
    p = F.lit("root/cls/a.b.svs")
    assert one(spark, paths.parent(p), paths.leaf(p), paths.slide_name(p), paths.stem(p), paths.parent(F.lit("x"))) == ("cls", "a.b.svs", "a", "a.b", None)
    assert one(spark, paths.tile_position(F.lit("d/12_7.jpeg")), paths.tile_position(F.lit("d/x.jpeg"))) == ((12, 7), (None, None))
    df = spark.createDataFrame([("Crème  brûlée--Ⅻ!",), (None,)], "t string")
    assert [r[0] for r in df.select(paths.slugify("t")).collect()] == ["creme_brulee_xii_", None]


def test_numbers(spark):
    assert one(spark, vectors.printed(F.lit(0.03125)), ids.zero_padded(F.lit(42)), ids.zero_padded(F.lit(123456)), ids.zero_padded(F.lit(None))) == (0.0312, "00042", "123456", None)
    assert one(spark, ids.whole_text(F.lit(1234567890.0), 11), ids.whole_text(F.lit(12.0)), ids.whole_text(F.lit(None))) == ("01234567890", "12", None)
    assert one(spark, ids.event_code(F.lit("Death")), ids.event_code(F.lit("?")), ids.flag(F.lit("maybe"))) == (2, None, None)


def test_cohort(spark):
    raw = spark.createDataFrame([("Yes", "Nei", 1, "No", "No"), ("No", "Ja", 2, "No", "No"), ("No", "Nei", None, "Yes", "No"), (None, "?", None, "No", "No")], "ESKD string, Mors string, Mors_year int, Transplant string, Dialysis string")
    df = cohort.cohort(raw)
    assert [r.RRT_or_death for r in df.collect()] == [0, 1, 1, None]
    assert sum(r["count"] for r in cohort.value_counts(df, list(cohort.EVENTS)).collect()) == 3
    shares = cohort.distribution(df, list(cohort.EVENTS))
    draws = cohort.simulated(shares, list(cohort.EVENTS), cohort.random_draws(spark, 600, 3))
    got = [r["count"] for r in draws.groupBy(*cohort.EVENTS).count().collect()]
    assert sum(got) == 600 and len(got) == 3 and min(got) > 140
    assert cohort.value_counts_each(df, ["nothing"]).count() == 0


def test_register_match(spark):
    p = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (3, "c")], "PersNummer long, EtterNavn string").withColumn("ForNavn", F.lit("x"))
    kb = spark.createDataFrame([(1, "k"), (1, "k")], "patient_fnr long, patient_id string")
    nkbr = spark.createDataFrame([(None,), (7,)], "patient_fnr long")
    reg = cohort.registers(kb, nkbr)
    assert {r.EtterNavn for r in cohort.matched(p, reg).collect()} == {"a", "n"} and cohort.matched(p, reg).count() == 2
    assert cohort.matched(p, reg, match_nulls=False).count() == 1
    assert {r.PersNummer for r in cohort.printed_ids(cohort.matched(p, reg), width=3).collect()} == {"001", None}


def test_attention(spark):
    df = spark.createDataFrame([("b", 1, [0.0, 0.0]), ("b", 2, [0.0, 0.0]), ("c", 5, [1.0, 2.0])], "bag string, inst int, features array<double>")
    scored = mil.instance_scores(df, [[1.0, 0.0], [0.0, 1.0]], [0.5, -0.5])
    crit = mil.critical_instances(scored)
    assert {(r.bag, r.cls): r.inst for r in crit.collect()} == {("b", 0): 1, ("b", 1): 1, ("c", 0): 5, ("c", 1): 5}
    w = mil.attention(df.withColumnRenamed("features", "q"), crit, 2)
    assert sorted((r.bag, r.inst, r.cls, r.weight) for r in w.collect()) == [("b", i, c, 0.5) for i in (1, 2) for c in (0, 1)] + [("c", 5, 0, 1.0), ("c", 5, 1, 1.0)]
    scores = mil.bag_scores(mil.bag_representation(mil.attention_states(df, crit, 2)), [[[1.0, 1.0], [0.0, 1.0]]], [10.0])
    assert {r.bag: r.score for r in scores.collect()} == {"b": 10.0, "c": 15.0}
    assert mil.milnet(df.limit(0), [[1.0, 0.0]], [[1.0, 1.0]], [[1.0]], [[[1.0, 1.0]]])["bag"].count() == 0


def test_milnet_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, wc, wh, wq, ker = rng.normal(size=(7, 4)), rng.normal(size=(2, 4)), rng.normal(size=(3, 4)), rng.normal(size=(3, 3)), rng.normal(size=(2, 2, 4))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "bag int, inst int, features array<double>")
    out = mil.milnet(df, wc.tolist(), wh.tolist(), wq.tolist(), ker.tolist())
    q = np.tanh(np.maximum(x @ wh.T, 0) @ wq.T)
    z = q @ q[(x @ wc.T).argmax(0)].T / np.sqrt(3)
    a = np.exp(z) / np.exp(z).sum(0)
    want = np.einsum("jik,ik->j", ker, a.T @ x)
    got = {r.cls: r.score for r in out["bag"].collect()}
    assert [got[0], got[1]] == pytest.approx(want.tolist())


def test_embedding_and_tokens(spark):
    class Tokens(features.LinearEmbedder):
        def __call__(self, batch):
            return super().__call__(batch).reshape(len(batch), 3, 4)

    df = spark.createDataFrame([(i, [float(i + j) for j in range(5)]) for i in range(2)], "inst int, pixels array<double>")
    rows = features.embedded(df, Tokens(5, 12), batch=1).collect()
    assert sorted((r.inst, r.token_idx, len(r.features)) for r in rows) == [(i, t, 4) for i in range(2) for t in range(3)]
    flat = features.embedded(df, features.LinearEmbedder(5, 12)).drop("token_idx")
    again = {(r.inst, r.token_idx): r.features for r in features.token_rows(flat, 4).collect()}
    assert again == {(r.inst, r.token_idx): r.features for r in rows}
    assert features.embedded(df.limit(0), Tokens(5, 12)).count() == 0
    with pytest.raises(Exception, match="needs torch"):
        features.embedded(df, features.TorchEmbedder(lambda: None, 4)).collect()


def test_tree_features_without_children(spark):
    low = spark.createDataFrame([("p", [1.0]), ("alone", [2.0])], "parent string, features array<double>")
    high = spark.createDataFrame([(1, "p", [3.0])], "inst int, parent string, features array<double>")
    assert [tuple(r) for r in features.tree_features(high, low, ["parent"], "cat").select("inst", "features").collect()] == [(1, [3.0, 1.0])]
    assert features.tree_features(high.limit(0), low, ["parent"]).count() == 0


def test_bags(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2)], "bag string, i int")
    listed = spark.createDataFrame([("a",), ("b",)], "bag string")
    assert [r.bag for r in manifest.empty_bags(listed, p, ["bag"]).collect()] == ["b"]
    m = spark.createDataFrame([(f"p{i}", 0) for i in range(50)], "path string, label int")
    a, b, c = ([r.path for r in manifest.shuffled(m, s).collect()] for s in (1, 1, 2))
    assert a == b != c and sorted(a) == sorted(c)


def test_settings():
    assert TilingConfig(magnifications=(1, 0)).magnifications == (0, 1) and TilingConfig(magnifications=(0, 1)).mode == "pyramid"
    assert FeatureConfig().width == 2560
    for bad in ({"backbone": "x"}, {"norm_layer": "x"}, {"magnification": "x"}, {"tree_fusion": "x"}, {"weights": "ImageNet"}, {"weights": "latest"}):
        with pytest.raises(ValueError):
            FeatureConfig(**bad)
    with pytest.raises(NotImplementedError):
        FeatureConfig(magnification="tree")
    with pytest.raises(ValueError):
        TilingConfig(magnifications=(0, 1, 2))


def test_bicubic_by_hand(spark):
    """Weights of the cubic at a = -1/2: 111/128, 29/128, -9/128, -3/128 at distances 1/4, 3/4, 5/4, 7/4."""
    row = np.array([[0, 0, 255, 255]], np.uint8)
    down = 255 * (29 - 9) / (111 + 111 + 29 - 9)  # the filter is twice as wide and ends with the image
    assert images.resized(row, 1, 2).tolist() == [[round(down), round(255 - down)]] == [[21, 234]]
    up = 255 * (29 - 3) / 128
    assert images.resized(row, 1, 8).tolist() == [[0, 0, 0, round(up), round(255 - up), 255, 255, 255]]  # what is over or under a byte is cut off
    assert images.resized(row.T, 2, 1).tolist() == [[21], [234]] and images.resized(row.repeat(4, 0), 2, 2).tolist() == [[21, 234]] * 2
    flat = np.full((5, 7, 3), 200, np.uint8)
    assert all((images.resized(flat, h, w) == 200).all() for h, w in ((1, 1), (13, 2), (64, 64), (5, 3)))
    got = one(spark, images.resize(1, 4, 1, 2)(F.lit(row.ravel().tolist())), images.resize(1, 4, 1, 2)(F.lit(None).cast("array<int>")), images.edge_score(2, 2, 1, 2)(F.lit(None).cast("array<int>")))
    assert got == ([21, 234], None, None)


def test_edge_scores_of_a_batch_are_those_of_each(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (20, 6, 5, 3), dtype=np.uint8)
    rows = [(i, bytearray(v.tobytes()), v.ravel().tolist()) if i % 5 else (i, None, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, b binary, a array<int>").select("i", *(images.edge_score(6, 5, 3, 6)(c).alias(c) for c in "ab"))
    for r in df.collect():
        if r.i % 5:
            own = x[r.i].astype(int)
            want = sum(sum(np.clip(9 * own[y, z, c] - own[y - 1 : y + 2, z - 1 : z + 2, c].sum(), 0, 255) if 0 < y < 5 and 0 < z < 4 else own[y, z, c] for y in range(6) for z in range(5)) for c in range(3)) / 3 / 36
            assert r.a == r.b == pytest.approx(want)
        else:
            assert r.a is None and r.b is None


def test_morton_codes(spark):
    places = [(0, 0), (1, 0), (0, 1), (3, 5), (65535, 1), (2**31 - 1, 2**31 - 1), (123456, 654321)]
    df = spark.createDataFrame(places, "col int, row int")
    want = [sum((c >> i & 1) << 2 * i | (r >> i & 1) << 2 * i + 1 for i in range(31)) for c, r in places]
    assert [r[0] for r in df.select(tiling.morton()).collect()] == want
    assert [r[0] for r in df.select(tiling.morton(F.expr("col div 2"), F.expr("row div 2")) == F.shiftright(tiling.morton(), 2)).collect()] == [True] * len(places)


def test_a_stored_tree_of_many_levels_is_joined_without_a_shuffle(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(s, d, c, r) for s in ("a", "b", "big") for d in range(4) for c in range(16 >> d) for r in range(16 >> d) if rng.random() < 0.8] + [("a", 0, None, 1), ("lost", 0, 5, 5)]
    tiles = spark.createDataFrame(rows, "slide_name string, depth int, col int, row int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for depths in ((0, 1, 2, 3), (0, 2, 3)):
            table = f"levels_{len(depths)}"
            tiling.store_levels(tiles, table, depths, f"{tmp_path}/{table}", buckets=8)
            tree = tiling.stored_tree(spark, table, depths)
            got = sorted(map(tuple, tree.collect()), key=str)
            plan = tree._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.count("SortMergeJoin") == len(depths) - 1 and "Exchange" not in plan
            have, order, want = {x for x in rows if x[2] is not None}, depths[::-1], []

            def below(s, path, i):
                if i == len(order) or path[-2] is None:
                    want.append((s, *path, *[None] * (2 * len(order) - len(path))))
                    return
                f = 2 ** (order[i - 1] - order[i])
                kids = [(c, r) for c in range(path[-2] * f, path[-2] * f + f) for r in range(path[-1] * f, path[-1] * f + f) if (s, order[i], c, r) in have]
                for k in kids or [(None, None)]:
                    below(s, (*path, *k), i + 1)

            for s, d, c, r in have:
                if d == 3:
                    below(s, (c, r), 1)
            assert got == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in (3, 4):
            for d in range(4):
                spark.sql(f"drop table if exists levels_{n}_{d}")


def test_weight_rules():
    stored = ["features.0.weight", "features.1.weight", "features.1.bias", "l1.weight", "l1.bias", "l2.weight", "l2.bias"]
    wanted = ["feature_extractor.0.weight", "feature_extractor.1.weight", "feature_extractor.1.bias", "fc.weight"]
    assert renamed(stored, wanted) == dict(zip(stored[:3], wanted))
    assert renamed(stored, wanted[:2]) == dict(zip(stored[:2], wanted)) and renamed(stored[:5], wanted) == {stored[0]: wanted[0]}
    for bad in ((stored[:4], wanted), ([], wanted), (["a", "a", *stored[3:]], wanted), (stored, ["x", "x"])):
        with pytest.raises(ValueError):
            renamed(*bad)
    tree = {"backbone": "resnet18", "magnification": "tree"}
    assert FeatureConfig(**tree, weights_low="a", weights_high="b").weights_high == "b"
    assert FeatureConfig(**tree, weights="ImageNet", norm_layer="batch").width == 512
    for bad in (tree, tree | {"weights_low": "a"}, tree | {"weights_low": "a", "weights_high": "latest"}, {"weights_high": "ImageNet"}):
        with pytest.raises(ValueError):
            FeatureConfig(**bad)


def grids(spark):
    """Two levels of a few slides, which Spark takes to be as small as the table of slides."""
    slides = spark.range(6).selectExpr("id as slide_name", "1000 + 300 * cast(id as int) as width", "1500 as height", "20d as objective")
    grid = tiling.tile_grid(tiling.level_plan(tiling.dealt(slides.coalesce(1)), 20, (0, 1)))
    return grid, grid.where("level = 1 and (col + row) % 3 <> 0"), grid.where("level = 0 and (slide_name + col) % 5 <> 0")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slides_are_dealt_before_their_tiles_are_enumerated(spark):
    grid = planned(grids(spark)[0])
    assert grid.index("Generate explode(sequence") < grid.index("Exchange hashpartitioning(slide_name")


def test_the_tree_broadcasts_no_grid(spark):
    _, low, high = grids(spark)
    have = [(r.slide_name, r.col, r.row) for r in high.collect()]
    want = []
    for s, c, r in ((x.slide_name, x.col, x.row) for x in low.collect()):
        own = [k for k in have if k[0] == s and k[1] // 2 == c and k[2] // 2 == r]
        want += [(s, c, r, *k[1:]) for k in own] or [(s, c, r, None, None)]
    tree = tiling.patch_tree(low, high, 2)
    assert "Broadcast" not in planned(tree) and "Broadcast" not in planned(tiling.patch_tree(low, high, 2, drop_childless=True))
    assert sorted(map(tuple, tree.collect()), key=str) == sorted(want, key=str) and len(want) > 50


def test_children_kept_broadcasts_no_grid(spark):
    _, low, high = grids(spark)
    have = {(r.slide_name, r.col, r.row) for r in low.collect()}
    want = sorted((r.slide_name, r.col, r.row) for r in high.collect() if (r.slide_name, r.col // 2, r.row // 2) in have)
    kept = tiling.children_kept(high, low, 2)
    assert "Broadcast" not in planned(kept)
    assert sorted((r.slide_name, r.col, r.row) for r in kept.collect()) == want and want


def test_pending_broadcasts_no_grid(spark):
    """Tiles that are stored twice, and in no order, are still left out once."""
    keys = ["slide_name", "mag", "col", "row"]
    grid = grids(spark)[0].select(*keys)
    stored = grid.where("(slide_name + col + row) % 3 = 0")
    left = tiling.pending(grid, stored.union(stored))
    assert "Broadcast" not in planned(left)
    want = sorted(tuple(r) for r in grid.collect() if (r.slide_name + r.col + r.row) % 3)
    assert sorted(map(tuple, left.collect())) == want and want
