"""Queries of the engine's operators on the driver tables, with their SQL.

No driver table holds images: ``embeddings`` stands for patches (a label is a bag, a vector also 8 x 8
pixels), ``part`` for slides, ``customer`` and ``orders`` for patients and registers, ``events`` for event
histories. Results are long rows of rounded numbers. Weights come from small integer formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesmith.functions import ids, images, paths, vectors
from tilesmith.operators import cohort, features, manifest, mil, tiling
from tilesmith.scratch import scratch_path
from tilesmith.sources import bags, files, slides
from tilesmith.streaming import bags as completed_bags

QUERIES: dict = {}
ORACLE: dict = {}

K, HID = 64, 16
CLASSES = [[((31 * p + 17 * j) % 13 - 6) / 13 for p in range(K)] for j in range(2)]
HIDDEN = [[((7 * p + 11 * h) % 13 - 6) / 13 for p in range(K)] for h in range(HID)]
QUERY = [[((5 * m + 3 * h) % 13 - 6) / 13 for h in range(HID)] for m in range(HID)]
KERNEL = [[[((31 * j + 17 * p + 7 * i) % 13 - 6) / 13 for p in range(K)] for i in range(2)] for j in range(2)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("label").alias("bag"), F.col("vec_id").alias("inst"), F.col("embedding").alias("features"))


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)  # no negative zero


LONG = "e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"


# ---- attention pooling ----


@query(f"WITH {LONG} SELECT label AS bag, vec_id AS inst, j::INT AS cls, round(sum(v * (((31 * pos + 17 * j) % 13 - 6) / 13e0)), 6) + 0e0 AS score FROM e, range(2) t(j) GROUP BY label, vec_id, j")
def mil_instance_scores(spark: SparkSession, d: str) -> DataFrame:
    return mil.instance_scores(_instances(spark, d), CLASSES).select("bag", "inst", "cls", _r("score").alias("score"))


@query(
    f"""WITH {LONG}, s AS (SELECT label, vec_id, j, round(sum(v * (((31 * pos + 17 * j) % 13 - 6) / 13e0)), 9) AS s FROM e, range(2) t(j) GROUP BY label, vec_id, j)
SELECT label AS bag, j::INT AS cls, arg_max(vec_id, (s, -vec_id)) AS inst, round(arg_max(embedding[1], (s, -vec_id))::DOUBLE, 6) + 0e0 AS head FROM s JOIN embeddings USING (label, vec_id) GROUP BY label, j"""
)
def mil_critical_of_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each class's critical instance in one pass, with the first element of its vector."""
    return mil.critical_of(_instances(spark, d), CLASSES, digits=9).select("bag", "cls", "inst", _r(F.col("critical")[0]).alias("head"))


def _first(spark: SparkSession, d: str) -> DataFrame:
    """Instances of one class whose score is the vector's first element."""
    return _instances(spark, d).withColumn("cls", F.lit(0)).withColumn("score", F.col("features")[0].cast("double"))


@query("SELECT label AS bag, arg_max(vec_id, (embedding[1], -vec_id)) AS inst, round(max(embedding[1])::DOUBLE, 6) + 0e0 AS score FROM embeddings GROUP BY label")
def mil_critical_instance(spark: SparkSession, d: str) -> DataFrame:
    return mil.critical_instances(_first(spark, d)).select("bag", "inst", _r(F.col("critical")[0].cast("double")).alias("score"))


ATTENTION = f"""{LONG},
crit AS (SELECT label, arg_max(vec_id, (embedding[1], -vec_id)) AS vec_id FROM embeddings GROUP BY label),
z AS (SELECT e.label, e.vec_id, sum(e.v * c.v) / sqrt(64e0) AS z FROM e JOIN crit k ON e.label = k.label JOIN e c ON c.vec_id = k.vec_id AND c.pos = e.pos GROUP BY e.label, e.vec_id),
x AS (SELECT label, vec_id, exp(z - max(z) OVER (PARTITION BY label)) AS x FROM z),
w AS (SELECT label, vec_id, x / sum(x) OVER (PARTITION BY label) AS w FROM x)"""


def _first_attention(spark: SparkSession, d: str) -> DataFrame:
    return mil.attention(_instances(spark, d).withColumnRenamed("features", "q"), mil.critical_instances(_first(spark, d)), K)


def _first_representation(spark: SparkSession, d: str) -> DataFrame:
    return mil.bag_representation(mil.attention_states(_instances(spark, d), mil.critical_instances(_first(spark, d)), K))


@query(f"WITH {ATTENTION} SELECT label AS bag, vec_id AS inst, round(w, 6) + 0e0 AS weight FROM w")
def mil_attention_weights(spark: SparkSession, d: str) -> DataFrame:
    return _first_attention(spark, d).select("bag", "inst", _r("weight").alias("weight"))


@query(f"WITH {ATTENTION} SELECT w.label AS bag, pos::INT AS pos, round(sum(w * v), 6) + 0e0 AS value FROM w JOIN e ON w.vec_id = e.vec_id GROUP BY w.label, pos")
def mil_bag_repr(spark: SparkSession, d: str) -> DataFrame:
    rows = _first_representation(spark, d).select("bag", F.posexplode("value").alias("pos", "v"))
    return rows.select("bag", "pos", _r("v").alias("value"))


@query(
    f"WITH {ATTENTION}, b AS (SELECT w.label, pos, sum(w * v) AS b FROM w JOIN e ON w.vec_id = e.vec_id GROUP BY w.label, pos) SELECT label AS bag, j::INT AS cls, round(sum(b * (((31 * j + 17 * pos) % 13 - 6) / 13e0)), 5) + 0e0 AS score FROM b, range(2) t(j) GROUP BY label, j"
)
def mil_bag_score(spark: SparkSession, d: str) -> DataFrame:
    return mil.bag_scores(_first_representation(spark, d), [k[:1] for k in KERNEL]).select("bag", "cls", _r("score", 5).alias("score"))


MAPPED = f"""{LONG},
h AS (SELECT vec_id, label, h, greatest(sum(v * (((7 * pos + 11 * h) % 13 - 6) / 13e0)), 0) AS hv FROM e, range({HID}) t(h) GROUP BY vec_id, label, h),
q AS (SELECT vec_id, label, m, tanh(sum(hv * (((5 * m + 3 * h) % 13 - 6) / 13e0))) AS q FROM h, range({HID}) t(m) GROUP BY vec_id, label, m)"""


@query(f"WITH {MAPPED} SELECT vec_id AS inst, m::INT AS m, round(q, 6) + 0e0 AS q FROM q")
def mil_query_map(spark: SparkSession, d: str) -> DataFrame:
    rows = _instances(spark, d).select("inst", F.posexplode(mil.query_map("features", HIDDEN, QUERY)).alias("m", "q"))
    return rows.select("inst", "m", _r("q").alias("q"))


@query(f"WITH {LONG} SELECT vec_id AS inst, h::INT AS h, round(greatest(sum(v * (((7 * pos + 11 * h) % 13 - 6) / 13e0)), 0), 6) + 0e0 AS value FROM e, range({HID}) t(h) GROUP BY vec_id, h")
def mil_value_map(spark: SparkSession, d: str) -> DataFrame:
    rows = _instances(spark, d).select("inst", F.posexplode(mil.value_map("features", HIDDEN)).alias("h", "value"))
    return rows.select("inst", "h", _r("value").alias("value"))


@query(
    f"""WITH {MAPPED},
s AS (SELECT vec_id, label, j, round(sum(v * (((31 * pos + 17 * j) % 13 - 6) / 13e0)), 9) AS s FROM e, range(2) t(j) GROUP BY vec_id, label, j),
crit AS (SELECT label, j, arg_max(vec_id, (s, -vec_id)) AS vec_id FROM s GROUP BY label, j),
z AS (SELECT q.label, q.vec_id, k.j, sum(q.q * c.q) / sqrt({HID}e0) AS z FROM q JOIN crit k ON q.label = k.label JOIN q c ON c.vec_id = k.vec_id AND c.m = q.m GROUP BY q.label, q.vec_id, k.j),
x AS (SELECT label, vec_id, j, exp(z - max(z) OVER (PARTITION BY label, j)) AS x FROM z),
w AS (SELECT label, vec_id, j, x / sum(x) OVER (PARTITION BY label, j) AS w FROM x),
b AS (SELECT w.label, w.j, e.pos, sum(w * v) AS b FROM w JOIN e ON w.vec_id = e.vec_id GROUP BY w.label, w.j, e.pos)
SELECT label AS bag, o::INT AS cls, round(sum(b * (((31 * o + 17 * pos + 7 * j) % 13 - 6) / 13e0)), 6) + 0e0 AS score FROM b, range(2) t(o) GROUP BY label, o"""
)
def milnet_full(spark: SparkSession, d: str) -> DataFrame:
    out = mil.milnet(_instances(spark, d), CLASSES, HIDDEN, QUERY, KERNEL, digits=9)
    return out["bag"].select("bag", "cls", _r("score").alias("score"))


# ---- features ----


@query(f"WITH {LONG} SELECT vec_id, pos::INT AS pos, round_even(v, 4) + 0e0 AS value FROM e")
def feature_rounding(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return rows.select("vec_id", "pos", (vectors.printed("v") + F.lit(0.0)).alias("value"))


@query("SELECT vec_id, " + ", ".join(f'round_even(embedding[{i + 1}]::DOUBLE, 4) + 0e0 AS "{i}"' for i in range(K)) + ", label FROM embeddings")
def feature_csv_wide(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "embeddings").withColumn("features", F.transform("embedding", lambda v: vectors.printed(v) + F.lit(0.0)))
    return df.select("vec_id", *vectors.wide("features", K), "label")


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    return e.withColumn("parent", F.expr("vec_id div 4")), e.select(F.col("vec_id").alias("parent"), "features")


@query(f"WITH {LONG} SELECT h.vec_id, h.pos::INT AS pos, round(h.v + 0.25e0 * l.v, 6) + 0e0 AS value FROM e h JOIN e l ON l.vec_id = h.vec_id // 4 AND l.pos = h.pos")
def tree_fusion_add(spark: SparkSession, d: str) -> DataFrame:
    rows = features.tree_features(*_tree(spark, d), ["parent"], "fusion").select("vec_id", F.posexplode("features").alias("pos", "v"))
    return rows.select("vec_id", "pos", _r("v").alias("value"))


@query(f"WITH {LONG} SELECT h.vec_id, h.pos::INT AS pos, round(h.v, 6) + 0e0 AS value FROM e h WHERE EXISTS (SELECT 1 FROM embeddings l WHERE l.vec_id = h.vec_id // 4) UNION ALL SELECT h.vec_id, (l.pos + {K})::INT, round(l.v, 6) + 0e0 FROM embeddings h JOIN e l ON l.vec_id = h.vec_id // 4")
def tree_fusion_cat(spark: SparkSession, d: str) -> DataFrame:
    rows = features.tree_features(*_tree(spark, d), ["parent"], "cat").select("vec_id", F.posexplode("features").alias("pos", "v"))
    return rows.select("vec_id", "pos", _r(F.col("v").cast("double")).alias("value"))


@query(f"WITH {LONG} SELECT vec_id, (pos // 8)::INT AS token_idx, (pos % 8)::INT AS pos, round(v, 6) + 0e0 AS value FROM e")
def token_explode(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    rows = features.token_rows(e, 8).select("vec_id", "token_idx", F.posexplode("features").alias("pos", "v"))
    return rows.select("vec_id", "token_idx", "pos", _r("v").alias("value"))


@query(f"WITH {LONG} SELECT vec_id AS inst, h::INT AS pos, round(sum(v * (((7 * pos + 11 * h) % 13 - 6) / 13e0)), 6) + 0e0 AS value FROM e, range({HID}) t(h) GROUP BY vec_id, h")
def embed_map_in_arrow(spark: SparkSession, d: str) -> DataFrame:
    patches = _table(spark, d, "embeddings").select(F.col("vec_id").alias("inst"), F.col("embedding").alias("pixels"))
    rows = features.embedded(patches, features.LinearEmbedder(K, HID)).select("inst", F.posexplode("features").alias("pos", "v"))
    return rows.select("inst", "pos", _r("v").alias("value"))


# ---- pixels ----


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    px = F.transform("embedding", lambda v: F.least(F.greatest(F.floor(F.lit(128.0) + F.lit(128.0) * v.cast("double")).cast("int"), F.lit(0)), F.lit(255)))
    return _table(spark, d, "embeddings").select("vec_id", px.alias("pixels"))


PIXELS = f"{LONG}, p AS (SELECT vec_id, pos, pos // 8 AS y, pos % 8 AS x, least(greatest(floor(128e0 + 128e0 * v)::INT, 0), 255) AS p FROM e)"
_MEAN, _STD = images.NORMS["H-optimus-1"]


@query(f"WITH {PIXELS} SELECT vec_id, pos::INT AS pos, round((p / 255e0 - ([{', '.join(f'{m}e0' for m in _MEAN)}])[pos % 3 + 1]) / ([{', '.join(f'{s}e0' for s in _STD)}])[pos % 3 + 1], 6) + 0e0 AS value FROM p")
def pixel_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = _pixels(spark, d).select("vec_id", F.posexplode(images.normalised("pixels", _MEAN, _STD)).alias("pos", "v"))
    return rows.select("vec_id", "pos", _r("v").alias("value"))


#: Divides the stand-in tiles of 8 x 8 pixels in two halves.
BACKGROUND = 85
EDGE = f"""{PIXELS},
n AS (SELECT a.vec_id, a.y, a.x, a.p, sum(b.p) AS around FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.y, a.x, a.p),
s AS (SELECT vec_id, sum(CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN p ELSE least(greatest(9 * p - around, 0), 255) END) / 64e0 AS edge FROM n GROUP BY vec_id)"""


@query(f"WITH {EDGE} SELECT vec_id, round(edge, 6) + 0e0 AS edge FROM s")
def edge_score(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("vec_id", _r(images.edge_score(8, 8, 1, 8)("pixels")).alias("edge"))


@query(f"WITH {EDGE} SELECT vec_id FROM s WHERE edge > {BACKGROUND}")
def background_filter(spark: SparkSession, d: str) -> DataFrame:
    tiles = _pixels(spark, d).select("vec_id", images.edge_score(8, 8, 1, 8)("pixels").alias("edge"))
    return tiling.foreground(tiles, BACKGROUND).select("vec_id")


@query(f"WITH {PIXELS} SELECT vec_id, ((y - 2) * 4 + x - 2)::INT AS pos, p::INT AS value FROM p WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5")
def center_crop(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("vec_id", F.posexplode(images.centre_crop("pixels", 8, 8, 4)).alias("pos", "value"))


@query(
    f"""WITH {PIXELS}, k0 AS (SELECT o, i, (o + 0.5e0) * 2 AS centre FROM range(4) t(o), range(8) u(i)),
k1 AS (SELECT o, i, CASE WHEN i < trunc(centre - 3.5e0) OR i >= trunc(centre + 4.5e0) THEN 0e0 ELSE abs((i - centre + 0.5e0) / 2) END AS x, i >= trunc(centre - 3.5e0) AND i < trunc(centre + 4.5e0) AS inside FROM k0),
k2 AS (SELECT o, i, CASE WHEN NOT inside THEN 0e0 WHEN x < 1 THEN (1.5e0 * x - 2.5e0) * x * x + 1 WHEN x < 2 THEN (((x - 5) * x + 8) * x - 4) * -0.5e0 ELSE 0e0 END AS w FROM k1),
k AS (SELECT o, i, trunc(w / sum(w) OVER (PARTITION BY o) * 4194304e0 + CASE WHEN w < 0 THEN -0.5e0 ELSE 0.5e0 END)::BIGINT AS k FROM k2),
a AS (SELECT vec_id, y, o AS x, least(greatest((sum(p * k)::BIGINT + 2097152) >> 22, 0), 255) AS p FROM p JOIN k ON k.i = p.x GROUP BY vec_id, y, o)
SELECT vec_id, (o * 4 + x)::INT AS pos, least(greatest((sum(p * k)::BIGINT + 2097152) >> 22, 0), 255)::INT AS value FROM a JOIN k ON k.i = a.y GROUP BY vec_id, o, x"""
)
def resize_bicubic(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("vec_id", F.posexplode(images.resize(8, 8, 4, 4)("pixels")).alias("pos", "value"))


# ---- written and read again ----


def _grey_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as grey tiles of 8 x 8 pixels in bags, placed by their id."""
    one = F.transform("pixels", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 3))
    rows = _pixels(spark, d).join(_table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    cls, slide = F.concat(F.lit("class_"), F.col("label") % 2), F.concat(F.lit("s"), F.col("label"))
    return rows.select(cls.alias("class_dir"), slide.alias("slide_name"), (F.col("vec_id") % 100).cast("int").alias("col"), F.floor(F.col("vec_id") / 100).cast("int").alias("row"), F.unhex(F.array_join(one, "")).alias("pixels"))


@query(f"WITH {PIXELS} SELECT 'class_' || label % 2 AS class_dir, 's' || label AS slide_name, vec_id % 100 AS col, vec_id // 100 AS \"row\", 8 AS width, sum(3 * p) AS total, sum(3 * p * (pos + 1)) AS weighed FROM p JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label, vec_id")
def bags_written(spark: SparkSession, d: str) -> DataFrame:
    """Bags of image files, committed as a whole, and scanned again."""
    root = scratch_path(spark, "bags")
    bags.write_bags(_grey_tiles(spark, d), root, 8)
    rows = files.patch_images(spark, root)
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda s, v: s + v)
    weighed = F.aggregate(F.transform("pixels", lambda v, i: v * (F.floor(i / 3) + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return rows.select("class_dir", "slide_name", F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), "width", total.alias("total"), weighed.alias("weighed"))


@query("SELECT 'class_' || label % 2 AS class_dir, 's' || label AS slide_name, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT NULL, NULL, count(*) FROM embeddings")
def bags_overwritten(spark: SparkSession, d: str) -> DataFrame:
    """Bags written twice, the second time over the first; files by bag, and all."""
    root, tiles = scratch_path(spark, "bags"), _grey_tiles(spark, d)
    bags.write_bags(tiles.withColumn("col", F.col("col") + 1000), root, 8)
    bags.write_bags(tiles, root, 8, overwrite=True)
    found = spark.read.format("binaryFile").load(f"{root}/*/*").select(paths.parent("path").alias("slide_name"), F.element_at(F.split("path", "/"), -3).alias("class_dir"))
    every = spark.range(1).select(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(files.image_count(spark, root, ("png",))).cast("long").alias("n"))
    return found.groupBy("class_dir", "slide_name").agg(F.count("*").alias("n")).union(every)


@query("SELECT c_name, c_acctbal > 0 AS rich, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS nation, round(c_acctbal, 2) AS balance FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A list written as CSV, and read by names and types; a column that isn't asked for is passed over."""
    path = scratch_path(spark, "list")
    rows = _table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 0).alias("rich"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("nation"), F.round("c_acctbal", 2).alias("balance"))
    files.write_list(rows, path)
    return files.csv(spark, path, "balance double, c_name string, nation int, rich boolean")


@query("SELECT s_name AS path, s_nationkey % 3 AS label FROM supplier")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    files.write_manifest(_table(spark, d, "supplier").select(F.col("s_name").alias("path"), (F.col("s_nationkey") % 3).alias("label")), path)
    return files.csv(spark, path, "`0` string, label int").withColumnRenamed("0", "path")


@query(f"WITH {LONG} SELECT 's' || label AS slide_name, pos::INT AS pos, round(sum(round_even(v, 4)), 6) + 0e0 AS total, count(*) AS n FROM e WHERE pos < 8 GROUP BY label, pos")
def features_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Wide feature tables by class and slide, with four decimals, and read again by their columns."""
    path = scratch_path(spark, "features")
    rows = _table(spark, d, "embeddings").select(F.lit("c").alias("class_dir"), F.concat(F.lit("s"), "label").alias("slide_name"), F.slice("embedding", 1, 8).alias("features"), "label")
    files.export_features(rows, path, 8)
    read = files.csv(spark, path, "slide_name string, " + ", ".join(f"`{i}` double" for i in range(8)))
    wide = read.select("slide_name", F.posexplode(F.array(*(F.col(str(i)) for i in range(8)))).alias("pos", "v"))
    return wide.groupBy("slide_name", "pos").agg(_r(F.sum("v")).alias("total"), F.count("*").alias("n"))


@query("SELECT user_id::VARCHAR AS slide, 5 + (user_id % 4 = 0)::BIGINT AS n_tiles, 5 AS n_seen, 'whole' AS status FROM events WHERE user_id % 4 <> 0 GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def bags_completed(spark: SparkSession, d: str) -> DataFrame:
    """A stream of tiles: kinds of events stand for a bag's tiles, and some bags wait for one that never comes."""
    kinds = F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view")))
    stream = spark.readStream.schema(_table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern may match a file or a folder
    tile = (F.array_position(kinds, F.col("event_type")) - 1).alias("tile")
    tiles = stream.select(F.col("user_id").alias("slide"), (5 + (F.col("user_id") % 4 == 0).cast("int")).alias("n_tiles"), tile)
    return completed_bags.ingest_bags(tiles, scratch_path(spark, "whole"), scratch_path(spark, "state"))


# ---- tiling ----


def _slides(spark: SparkSession, d: str) -> DataFrame:
    cols = {"slide_name": F.col("p_partkey"), "width": 1000 + 37 * F.col("p_size"), "height": 700 + 29 * F.col("p_size"), "objective": F.when(F.col("p_size") % 3 == 0, 20.0).when(F.col("p_size") % 3 == 1, 40.0).otherwise(30.0)}
    return tiling.dealt(_table(spark, d, "part").select(*(c.alias(n) for n, c in cols.items())))


PLAN = """sl AS (SELECT p_partkey AS slide_name, 1000 + 37 * p_size AS width, 700 + 29 * p_size AS height, CASE p_size % 3 WHEN 0 THEN 20e0 WHEN 1 THEN 40e0 ELSE 30e0 END AS objective FROM part),
pl AS (SELECT sl.*, m::INT AS level, (m + trunc(log2(objective / 20e0)))::INT AS depth, (ceil(log2(greatest(width, height))) + 1)::INT AS level_count FROM sl, (VALUES (0), (1)) t(m)),
plan AS (SELECT slide_name, width, height, objective, level, depth, floor(objective / pow(2, depth))::INT AS mag, (level_count - depth - 1)::INT AS dz_level FROM pl WHERE depth >= 0 AND depth < level_count)"""
GRID = f"""{PLAN},
lv AS (SELECT *, ceil(width / pow(2, depth))::INT AS lw, ceil(height / pow(2, depth))::INT AS lh FROM plan),
ro AS (SELECT *, unnest(range(ceil(lh / 224e0)::BIGINT))::INT AS "row" FROM lv),
grid AS (SELECT *, unnest(range(ceil(lw / 224e0)::BIGINT))::INT AS col FROM ro)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return tiling.level_plan(_slides(spark, d), 20, (0, 1))


@query(f"WITH {PLAN} SELECT slide_name, level, depth, mag, dz_level FROM plan")
def tile_level_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("slide_name", "level", "depth", "mag", "dz_level")


@query(f"WITH {PLAN} SELECT slide_name, mag, row_number() OVER (PARTITION BY slide_name ORDER BY mag)::INT AS position FROM plan")
def mag_order(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("slide_name", "mag", F.col("position").cast("int").alias("position"))


@query(f'WITH {GRID} SELECT slide_name, mag, col, "row" FROM grid')
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile_grid(_plan(spark, d)).select("slide_name", "mag", "col", "row")


@query(
    f"""WITH {GRID} SELECT slide_name, mag, col, "row", greatest(col * 224 - 8, 0)::INT AS x0, greatest("row" * 224 - 8, 0)::INT AS y0,
(least((col + 1) * 224 + 8, lw) - greatest(col * 224 - 8, 0))::INT AS w, (least(("row" + 1) * 224 + 8, lh) - greatest("row" * 224 - 8, 0))::INT AS h FROM grid"""
)
def tile_geometry(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile_geometry(tiling.tile_grid(_plan(spark, d)), 224, 8).select("slide_name", "mag", "col", "row", "x0", "y0", "w", "h")


@query(
    f"""WITH {GRID.replace("1000 + 37 * p_size AS width, 700 + 29 * p_size AS height", "900 + 37 * p_size AS width, 640 + 29 * p_size AS height")}
SELECT slide_name, mag, col, "row", (60 + p_off + greatest(col * 224 - 8, 0) * pow(2, depth))::INT AS read_x, (40 + greatest("row" * 224 - 8, 0) * pow(2, depth))::INT AS read_y
FROM grid JOIN (SELECT p_partkey, p_size % 7 AS p_off FROM part) ON p_partkey = slide_name"""
)
def tile_geometry_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Slides cut down to bounds; tiles begin at the bounds' offset."""
    size = _table(spark, d, "part").select(F.col("p_partkey").alias("slide_name"), (60 + F.col("p_size") % 7).alias("x"))
    bounds = F.struct("x", F.lit(40).alias("y"), (F.col("width") - 100).alias("width"), (F.col("height") - 60).alias("height"))
    slides = tiling.bounded(_slides(spark, d).join(size, "slide_name").withColumn("bounds", bounds))
    grid = tiling.tile_grid(tiling.level_plan(slides, 20, (0, 1)))
    return tiling.tile_geometry(grid, 224, 8).select("slide_name", "mag", "col", "row", "read_x", "read_y")


@query("SELECT p_partkey AS slide_name, TRY_CAST(p AS INT)::DOUBLE AS objective, CASE WHEN TRY_CAST(p AS INT) IS NULL THEN 'bad objective power: ' || p END AS error FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '20' WHEN 1 THEN 'x40' ELSE '40' END AS p FROM part)")
def slide_objective_errors(spark: SparkSession, d: str) -> DataFrame:
    """A damaged property is an error of its slide and stops no other."""
    told = F.when(F.col("p_size") % 4 == 0, "20").when(F.col("p_size") % 4 == 1, "x40").otherwise("40")
    slides = _table(spark, d, "part").select(F.col("p_partkey").alias("slide_name"), F.create_map(F.lit("openslide.objective-power"), told).alias("properties"))
    return tiling.with_objective(slides).select("slide_name", "objective", "error")


@query(
    """WITH s AS (SELECT p_partkey, 1000 + 37 * p_size AS width, 700 + 29 * p_size AS height, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'wide' ELSE (p_size * 3)::VARCHAR END AS bx, CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE (900 + p_size)::VARCHAR END AS bw FROM part)
SELECT p_partkey AS slide_name, CASE WHEN bx = 'wide' THEN 'bad bounds x: wide' WHEN bw = '0' THEN 'bad bounds width: 0' END AS error,
CASE WHEN bx = 'wide' OR bw = '0' THEN 0 ELSE coalesce(TRY_CAST(bx AS INT), 0) END AS offset_x, CASE WHEN bx = 'wide' OR bw = '0' THEN width ELSE coalesce(TRY_CAST(bw AS INT), width) END AS width, height FROM s"""
)
def slide_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds from properties: a part that is missing is the whole slide's, a damaged one is an error of its slide."""
    x = F.when(F.col("p_size") % 5 == 1, "wide").when(F.col("p_size") % 5 > 1, (F.col("p_size") * 3).cast("string"))
    w = F.when(F.col("p_size") % 4 == 0, "0").when(F.col("p_size") % 4 > 1, (F.col("p_size") + 900).cast("string"))
    told = F.map_filter(F.create_map(F.lit("openslide.bounds-x"), x, F.lit("openslide.bounds-width"), w), lambda _, v: v.isNotNull())
    slides = _table(spark, d, "part").select(F.col("p_partkey").alias("slide_name"), (1000 + 37 * F.col("p_size")).alias("width"), (700 + 29 * F.col("p_size")).alias("height"), told.alias("properties"))
    return tiling.bounded(tiling.with_bounds(slides)).select("slide_name", "error", "offset_x", "width", "height")


@query(
    """WITH s AS (SELECT 'set/' || s_suppkey || '.svs' AS path, sha256('set/' || s_suppkey || '.svs') AS d FROM supplier),
l AS (SELECT path, depth::INT AS depth, ceil((600 + 4 * ('0x' || substr(d, 1, 2))::INT) / pow(2, depth))::INT AS w, ceil((500 + 4 * ('0x' || substr(d, 3, 2))::INT) / pow(2, depth))::INT AS h FROM s, (VALUES (1), (2)) t(depth)),
r AS (SELECT *, unnest(range(ceil(h / 128e0)::BIGINT))::INT AS "row" FROM l), c AS (SELECT *, unnest(range(ceil(w / 128e0)::BIGINT))::INT AS col FROM r)
SELECT path, depth, col, "row", 128 * 128 * 3 AS n_bytes FROM c WHERE "row" < 2 AND col >= 1 AND col < 3"""
)
def tile_source_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of slides that were described once: rows and columns that aren't asked for are neither planned nor read."""
    names = _table(spark, d, "supplier").select(F.concat(F.lit("set/"), "s_suppkey", F.lit(".svs")).alias("path"))
    table = scratch_path(spark, "described")
    slides.described(names).select("path", "width", "height", "error").write.parquet(table)
    slides.register(spark)
    tiles = spark.read.format("tilesmith_tiles").options(described=table, depths="1,2", tile_size=128, rows=":2", cols="1:3").load()
    return tiles.select("path", "depth", "col", "row", F.octet_length("pixels").alias("n_bytes"))


def _two_levels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """High and low tiles; some low ones are dropped by a formula, as the background filter would."""
    grid = tiling.tile_grid(_plan(spark, d))
    low = grid.where("level = 1 and (slide_name + 3 * col + 5 * row) % 4 <> 0").select("slide_name", "col", "row")
    high = grid.where("level = 0 and (slide_name + col) % 5 <> 0").select("slide_name", "col", "row")
    return high, low


TWO = f"""{GRID}, low AS (SELECT slide_name, col, "row" FROM grid WHERE level = 1 AND (slide_name + 3 * col + 5 * "row") % 4 <> 0), high AS (SELECT slide_name, col, "row" FROM grid WHERE level = 0 AND (slide_name + col) % 5 <> 0)"""


@query(f'WITH {TWO} SELECT h.slide_name, h.col, h."row", h.col // 2 AS parent_col, h."row" // 2 AS parent_row FROM high h WHERE EXISTS (SELECT 1 FROM low l WHERE l.slide_name = h.slide_name AND l.col = h.col // 2 AND l."row" = h."row" // 2)')
def quadtree_semi(spark: SparkSession, d: str) -> DataFrame:
    return tiling.children_kept(*_two_levels(spark, d), 2).select("slide_name", "col", "row", "parent_col", "parent_row")


@query(f'WITH {TWO} SELECT l.slide_name, l.col, l."row", h.col AS child_col, h."row" AS child_row FROM low l LEFT JOIN high h ON l.slide_name = h.slide_name AND l.col = h.col // 2 AND l."row" = h."row" // 2')
def quadtree_left(spark: SparkSession, d: str) -> DataFrame:
    high, low = _two_levels(spark, d)
    return tiling.patch_tree(low, high, 2)


@query(f'WITH {GRID} SELECT slide_name, mag, col, "row" FROM grid g WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM grid WHERE (slide_name + col + "row") % 3 = 0) s WHERE s.slide_name = g.slide_name AND s.mag = g.mag AND s.col = g.col AND s."row" = g."row")')
def tile_resume_anti(spark: SparkSession, d: str) -> DataFrame:
    grid = tiling.tile_grid(_plan(spark, d)).select("slide_name", "mag", "col", "row")
    return tiling.pending(grid, grid.where("(slide_name + col + row) % 3 = 0"))


THREE = GRID.replace("(VALUES (0), (1)) t(m)", "(VALUES (0), (1), (2)) t(m)")


@query(
    f"""WITH {THREE}, t AS (SELECT slide_name, level, col, "row" FROM grid WHERE (slide_name + 3 * col + 5 * "row" + level) % 4 <> 0)
SELECT a.slide_name, a.col AS col_2, a."row" AS row_2, b.col AS col_1, b."row" AS row_1, c.col AS col_0, c."row" AS row_0 FROM (SELECT * FROM t WHERE level = 2) a
LEFT JOIN (SELECT * FROM t WHERE level = 1) b ON a.slide_name = b.slide_name AND b.col // 2 = a.col AND b."row" // 2 = a."row"
LEFT JOIN (SELECT * FROM t WHERE level = 0) c ON b.slide_name = c.slide_name AND c.col // 2 = b.col AND c."row" // 2 = b."row" """
)
def tree_of_three_levels(spark: SparkSession, d: str) -> DataFrame:
    """A stored tree over three magnifications, some tiles of each dropped by a formula; joined by bucket."""
    grid = tiling.tile_grid(tiling.level_plan(_slides(spark, d), 20, (0, 1, 2)))
    tiles = grid.where("(slide_name + 3 * col + 5 * row + level) % 4 <> 0").select("slide_name", F.col("level").alias("depth"), "col", "row")
    path = scratch_path(spark, "levels")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    tiling.store_levels(tiles, table, (0, 1, 2), path, buckets=8)
    return tiling.stored_tree(spark, table, (0, 1, 2))


# ---- paths and labels ----


@query("SELECT page_id, string_split(url, '/')[-2] AS class_dir, string_split(string_split(url, '/')[-1], '.')[1] AS slide_name, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem FROM pages")
def path_parse(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", paths.parent("url").alias("class_dir"), paths.slide_name("url").alias("slide_name"), paths.stem("url").alias("stem"))


@query("SELECT s_suppkey, (s_suppkey % 100)::INT AS col, (s_suppkey // 7)::INT AS \"row\" FROM supplier")
def tile_name_parse(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("data/c/s/"), F.col("s_suppkey") % 100, F.lit("_"), F.expr("s_suppkey div 7"), F.lit(".jpeg"))
    return _table(spark, d, "supplier").select("s_suppkey", paths.tile_position(name).alias("t")).select("s_suppkey", "t.col", "t.row")


@query("SELECT p_partkey, regexp_replace(lower(p_name || '--' || p_type), '[^a-z0-9]+', '_', 'g') AS slug FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", paths.slugify(F.concat_ws("--", "p_name", "p_type"), ascii_only=True).alias("slug"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN -1 ELSE c_nationkey END AS label FROM customer")
def class_label(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("c_nationkey") < 5, "other").when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("class_"), F.col("c_nationkey"), F.lit("_x"))).otherwise(F.concat(F.lit("class_"), F.col("c_nationkey")))
    return _table(spark, d, "customer").select("c_custkey", paths.class_label(name).alias("label"))


@query("SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS label_ordinal FROM customer")
def class_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return manifest.with_ordinal(_table(spark, d, "customer"), "c_mktsegment").select("c_custkey", "label_ordinal")


@query("SELECT page_id FROM pages WHERE regexp_matches(string_split(url, '/')[3], '\\.(?:org|net)$')")
def extension_filter(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").where(paths.has_extension(F.split("url", "/")[2], ".org", "net")).select("page_id")


@query("SELECT label AS bag FROM embeddings GROUP BY label")
def bag_listing(spark: SparkSession, d: str) -> DataFrame:
    return manifest.bags(_instances(spark, d), ["bag"])


@query("SELECT label AS bag, count(*) AS n FROM embeddings GROUP BY label")
def bag_size(spark: SparkSession, d: str) -> DataFrame:
    return manifest.bag_sizes(_instances(spark, d), ["bag"]).withColumnRenamed("count", "n")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def empty_bags(spark: SparkSession, d: str) -> DataFrame:
    return manifest.empty_bags(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels"), ["doc_id"])


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 5")
def slide_preview(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", "url").orderBy("page_id").limit(5)


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").select(F.col("c_name").alias("path"), F.lit(0).alias("label"), F.col("c_nationkey").alias("extra"))
    s = _table(spark, d, "supplier").select(F.lit(1).alias("label"), F.col("s_name").alias("path"))
    return manifest.united(c, s)


MANIFEST = "m AS (SELECT c_name AS path, 0 AS label, c_nationkey AS extra FROM customer UNION ALL BY NAME SELECT 1 AS label, s_name AS path FROM supplier)"


@query(f"WITH {MANIFEST} SELECT path, label, extra FROM m")
def manifest_union(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).select("path", "label", "extra")


@query(f"WITH {MANIFEST} SELECT label, count(*) AS n FROM m GROUP BY label")
def manifest_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest.class_counts(_manifest(spark, d)).withColumnRenamed("count", "n")


@query("SELECT c_custkey, (c_custkey * 1103515245 + 12345) % 2147483648 AS place FROM customer ORDER BY place, c_custkey")
def manifest_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """In the order of a congruential key that both engines have; the API hashes with a seed. Sorted by ranges, so no task sees all rows."""
    key = (F.col("c_custkey") * 1103515245 + 12345) % 2147483648
    return _table(spark, d, "customer").select("c_custkey", key.alias("place")).orderBy("place", "c_custkey")


# ---- cohorts ----


@query("SELECT c_custkey, printf('%05d', c_custkey * 97) AS padded FROM customer")
def id_zero_pad(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select("c_custkey", ids.zero_padded(F.col("c_custkey") * 97).alias("padded"))


@query("SELECT c_custkey, printf('%.0f', (c_custkey * 7919 + 10000000000)::DOUBLE) AS text FROM customer")
def id_format(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select("c_custkey", ids.whole_text((F.col("c_custkey") * 7919 + F.lit(10000000000)).cast("double")).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE printf('%05d', c_custkey) END AS padded FROM customer")
def null_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select("c_custkey", ids.zero_padded(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey"))).alias("padded"))


@query(
    """WITH p AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS PersNummer, c_mktsegment AS EtterNavn FROM customer),
r AS (SELECT CASE WHEN o_custkey % 15 = 0 THEN NULL ELSE o_custkey END AS patient_fnr FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 200000)
SELECT DISTINCT PersNummer, EtterNavn FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.patient_fnr IS NOT DISTINCT FROM p.PersNummer)"""
)
def register_match(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("PersNummer"), F.col("c_mktsegment").alias("EtterNavn"))
    o = _table(spark, d, "orders").where("o_orderpriority like '1%' and o_totalprice > 200000").select(F.when(F.col("o_custkey") % 15 != 0, F.col("o_custkey")).alias("patient_fnr"))
    half = F.col("patient_fnr") % 2 == 0
    both = cohort.registers(o.where(half), o.where(~half | F.col("patient_fnr").isNull()).withColumn("patient_id", F.lit(1)))
    return cohort.matched(p, both, keep=("PersNummer", "EtterNavn"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """A cohort row for each user, words made flags as in a raw table."""
    when = lambda kind, least: (F.col("event_type") == kind) & (F.col("value") > least)
    word = lambda cond, no, yes: F.when(F.max(cond.cast("int")) == 1, yes).otherwise(no)
    raw = _table(spark, d, "events").groupBy("user_id").agg(
        word(F.col("event_type") == "signup", "No", "Yes").alias("ESKD"), word(when("error", 100), "Nei", "Ja").alias("Mors"),
        word(when("click", 120), "No", "Yes").alias("Transplant"), word(when("view", 150), "No", "Yes").alias("Dialysis"),
    )
    return cohort.cohort(raw)


FLAGS = """f AS (SELECT user_id, max((event_type = 'signup')::INT) AS "ESKD", max((event_type = 'error' AND value > 100)::INT) AS "Death",
max((event_type = 'click' AND value > 120)::INT) AS "Transplant", max((event_type = 'view' AND value > 150)::INT) AS "Dialysis" FROM events GROUP BY user_id)"""
_E = list(cohort.EVENTS)
_COLS = ", ".join(f'"{e}"' for e in _E)


@query(f"WITH {FLAGS} SELECT user_id, {_COLS} FROM f")
def event_flags(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("user_id", *_E)


@query(f'WITH {FLAGS} SELECT user_id, 1 - (1 - "Death") * (1 - "Transplant") * (1 - "Dialysis") AS "RRT_or_death" FROM f')
def event_any_flag(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("user_id", "RRT_or_death")


@query(f'WITH {FLAGS} SELECT CASE WHEN user_id % 9 = 0 THEN NULL ELSE "ESKD" END AS "ESKD", "Death", "Transplant", "Dialysis", count(*) AS n FROM f WHERE user_id % 9 <> 0 GROUP BY ALL')
def event_value_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("ESKD", F.when(F.col("user_id") % 9 != 0, F.col("ESKD")))
    return cohort.value_counts(rows, _E).withColumnRenamed("count", "n")


@query(
    f"""WITH {FLAGS}, g AS (SELECT *, 1 - (1 - "Death") * (1 - "Transplant") * (1 - "Dialysis") AS "RRT_or_death" FROM f)
{" UNION ALL ".join(f'''SELECT '{c}' AS "column", "{c}" AS value, count(*) AS n FROM g GROUP BY "{c}"''' for c in ("RRT_or_death", *_E))}"""
)
def event_value_counts_single(spark: SparkSession, d: str) -> DataFrame:
    return cohort.value_counts_each(_events(spark, d), ["RRT_or_death", *_E, "First_event_RRT_death"]).withColumnRenamed("count", "n")


@query(
    """WITH f AS (SELECT user_id, (user_id % 3 = 0)::INT AS "RRT_or_death", (user_id % 5)::INT AS "First_event_RRT_death" FROM events GROUP BY user_id)
SELECT 'RRT_or_death' AS "column", "RRT_or_death" AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'First_event_RRT_death', "First_event_RRT_death", count(*) FROM f GROUP BY 2"""
)
def event_value_counts_given(spark: SparkSession, d: str) -> DataFrame:
    """A cohort that brings both columns keeps them."""
    raw = _table(spark, d, "events").select("user_id").distinct()
    raw = raw.withColumns({e: F.lit("No") for e in ("ESKD", "Transplant", "Dialysis")} | {"Mors": F.lit("Nei"), "RRT_or_death": (F.col("user_id") % 3 == 0).cast("int"), "First_event_RRT_death": (F.col("user_id") % 5).cast("int")})
    return cohort.value_counts_each(cohort.cohort(raw), ["RRT_or_death", "First_event_RRT_death"]).withColumnRenamed("count", "n")


@query(f"WITH {FLAGS} SELECT {_COLS}, round(count(*) / sum(count(*)) OVER (), 6) AS probability FROM f GROUP BY {_COLS}")
def event_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return cohort.distribution(_events(spark, d), _E).select(*_E, F.round("probability", 6).alias("probability"))


@query(
    f"""WITH {FLAGS}, c AS (SELECT {_COLS}, count(*) AS n FROM f GROUP BY {_COLS}),
s AS (SELECT *, n / (SELECT sum(n) FROM c)::DOUBLE AS p, sum(n) OVER (ORDER BY n DESC, {_COLS}) AS hi, (SELECT sum(n) FROM c) AS whole FROM c),
u AS (SELECT range AS id, (range * 1103515245 + 12345) % 2147483648 AS u FROM range(1000))
SELECT id, {_COLS}, round(p, 6) AS probability FROM u JOIN s ON (u * whole) // 2147483648 < hi AND (u * whole) // 2147483648 >= hi - n"""
)
def event_simulate(spark: SparkSession, d: str) -> DataFrame:
    """Draws from a congruential sequence that both engines have; the API draws at random with a seed.

    u is put in the middle of a step of 1 / rows, so that no draw falls on the edge of one.
    """
    rows = _events(spark, d)
    n = rows.agg(F.count("*")).scalar()
    draws = spark.range(1000).select("id", ((F.floor(((F.col("id") * 1103515245 + 12345) % 2147483648) * n / 2147483648) + 0.5) / n).alias("u"))
    return cohort.simulated(cohort.distribution(rows, _E), _E, draws).select("id", *_E, F.round("probability", 6).alias("probability"))


@query("SELECT user_id, CASE arg_min(event_type, event_id) WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 0 END AS code FROM events GROUP BY user_id")
def event_first_code(spark: SparkSession, d: str) -> DataFrame:
    """The codebook on each user's first event; which event comes first is an addition of this engine."""
    names = {"signup": "ESKD", "error": "Death", "click": "Transplant", "view": "Dialysis"}
    first = _table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("e"))
    return first.replace(names, subset="e").select("user_id", F.coalesce(ids.event_code("e"), F.lit(0)).alias("code"))
