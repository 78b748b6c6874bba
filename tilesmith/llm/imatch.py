"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band (so inverse document frequency
lies in one too). Beside the whole of it, random subsets of it are used, in families of falling density; for each, a
document's distinct terms in the subset are sorted and hashed. A fingerprint is the list of these
hashes: equal texts agree in all, and an edit changes only the subsets that hold an edited
term, so the share of equal hashes grades likeness. The band's lower end bounds the lexicon:
terms in at least a share s of all documents number at most (mean distinct terms a document) / s,
whatever the corpus, and its size is checked before it is broadcast.

Documents are dealt once, with their texts, into runs of RUN_DOCS neighbours by doc_id; each run also
gets a copy of the next run's first document, so that "the next document" is found inside the run.
Terms are looked up and gathered inside the same partitions.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilesmith.llm.common import dropped, small, written

#: Shares of all documents between which a lexicon term's document frequency lies.
BAND = (0.0005, 0.2)
#: A term in fewer documents than this is never in the lexicon.
LEAST_DOCS = 2
#: Each of FAMILIES draws a term's level, r with probability 2 ** -(r + 1); its subset r holds the terms of
#: level r and up, for r from 1 to LEVELS, so each subset is a random half of the one before.
FAMILIES = 4
LEVELS = 12
SUBSETS = 1 + FAMILIES * LEVELS
#: Documents in a run.
RUN_DOCS = 2000
#: First keys of runs, 32 bytes each, beyond which they are joined by a shuffle instead of a broadcast.
MOST_CUTS = 4_000_000
#: Lexicon terms beyond which it is joined by a shuffle instead of a broadcast.
BROADCAST_TERMS = 1_000_000


def terms(text: Column) -> Column:
    """Distinct lower-case terms of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term, n_docs, z0, z1, ... int), stored: the terms of the band, and their level in each family.

    Terms are counted over all documents; a null text has none.
    """
    n = docs.count()
    rows = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))
    kept = rows.where(F.col("n_docs").between(max(LEAST_DOCS, band[0] * n), band[1] * n))

    def level(f: int) -> Column:  # zero bits at the end of a hash
        zeros = (F.xxhash64(F.lit(f), "term").bitwiseAND(F.lit((1 << r) - 1).cast("long")) == 0 for r in range(1, LEVELS + 1))
        return sum((z.cast("int") for z in zeros), F.lit(0))

    return written(kept.select("term", "n_docs", *(level(f).alias(f"z{f}") for f in range(FAMILIES))), "lexicon")


def with_fingerprints(df: DataFrame, lists: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a fingerprint, array<long> of SUBSETS 32-bit hashes, for each name: (list, whole) of ``lists``.

    list: sorted array<struct<term, z0, ...>> of a document's lexicon terms. A hash is null where the
    subset holds none of them. The first is of the whole lexicon; in a document without lexicon terms
    it is the hash ``whole`` of all its terms. The lists are halved level by level, each from the one before.
    """
    low = F.lit(0xFFFFFFFF).cast("long")
    for name, (own, _) in lists.items():
        df = df.withColumns({f"_{name}_{f}": F.col(own) for f in range(FAMILIES)})
    for r in range(1, LEVELS + 1):
        df = df.withColumns({f"_{name}_{f}": F.filter(f"_{name}_{f}", _from_level(f"z{f}", r)) for name in lists for f in range(FAMILIES)})
        hashes = {}
        for name in lists:
            for f in range(FAMILIES):
                own = F.col(f"_{name}_{f}")
                hashes[f"_{name}_{r}_{f}"] = F.when(F.size(own) > 0, F.xxhash64(F.lit(r * FAMILIES + f), F.transform(own, lambda x: x["term"])).bitwiseAND(low))
        df = df.withColumns(hashes)
    made = {}
    for name, (own, whole) in lists.items():
        parts = [F.col(f"_{name}_{r}_{f}") for r in range(1, LEVELS + 1) for f in range(FAMILIES)]
        first = F.when(F.size(own) == 0, F.col(whole)).otherwise(F.xxhash64(F.lit(0), F.transform(own, lambda x: x["term"])))
        made[name] = F.array(first.bitwiseAND(low), *parts)
    df = df.withColumns(made)
    return df.drop(*(c for c in df.columns if any(c.startswith(f"_{name}_") for name in lists)))


def _from_level(z: str, r: int):
    return lambda x: x[z] >= r


def told(fp: Column) -> Column:
    """A fingerprint as text: 8 hex digits a subset, or as many dots."""
    return F.array_join(F.transform(fp, lambda x: F.when(x.isNull(), "........").otherwise(F.lower(F.lpad(F.hex(x), 8, "0")))), "")


def likeness(a: str, b: str) -> Column:
    """Of the subsets in which either fingerprint has a hash, the share in which both have the same."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.when(x.eqNullSafe(y), 1.0).otherwise(0.0)))
    start = F.struct(F.lit(0.0).alias("same"), F.lit(0.0).alias("all"))
    add = lambda s, x: F.struct((s["same"] + F.coalesce(x, F.lit(0.0))).alias("same"), (s["all"] + F.when(x.isNull(), 0.0).otherwise(1.0)).alias("all"))
    return F.aggregate(pairs, start, add, lambda s: s["same"] / s["all"])


def _last_at_most(cuts: Column, key: Column, steps: int) -> Column:
    """Place of the last of the ascending cuts that is at most key, by halving; the first one is. steps: halvings that one cut is left after."""
    middle = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    ends = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    halved = lambda s, _: F.when(F.get(cuts, middle(s)) <= key, ends(middle(s), s["hi"])).otherwise(ends(s["lo"], middle(s)))
    return F.aggregate(F.array_repeat(F.lit(0), steps), ends(F.lit(0), F.size(cuts)), halved, lambda s: s["lo"])


def _with_runs(rows: DataFrame) -> DataFrame:
    """rows of (doc_id, text, hash), with their run, and whether they are its first row.

    Runs are RUN_DOCS rows in order of (doc_id, hash), however many: the keys alone are put in order, in about as many
    parts as a part then has runs, and each RUN_DOCS-th key of a part is a cut. A row finds its part among the parts'
    first keys and its run among the cuts of the part. Rows that share id and hash are in one run.
    """
    key = F.struct("doc_id", "hash")
    keys = written(rows.select("doc_id", "hash"), "keys")
    parts = max(1, isqrt(keys.count() // RUN_DOCS))
    w = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "hash")
    placed = keys.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "hash").withColumn("part", F.spark_partition_id())
    cuts = placed.withColumn("i", F.row_number().over(w)).where((F.col("i") - 1) % RUN_DOCS == 0).groupBy("part").agg(F.array_sort(F.collect_set(key)).alias("cuts"))
    cuts = written(cuts, "cuts")
    dropped(keys)
    found = cuts.select("part", F.get("cuts", F.lit(0)).alias("first"), F.size("cuts").alias("n")).orderBy("part").collect()  # a row a part
    if not found:
        return rows.withColumns({"run": F.lit(0).cast("long"), "runs": F.lit(1).cast("long"), "is_first": F.lit(True)})
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    firsts = F.arrays_zip(longs(r.first.doc_id for r in found).alias("doc_id"), longs(r.first.hash for r in found).alias("hash"))
    starts, total = [0], sum(r.n for r in found)
    for r in found[:-1]:
        starts.append(starts[-1] + r.n)
    place = _last_at_most(firsts, key, len(found).bit_length())
    rows = rows.withColumn("place", place).withColumns({"_part": F.get(F.array(*(F.lit(r.part) for r in found)), "place"), "start": F.get(longs(starts), "place")})
    side = cuts.select(F.col("part").alias("_part"), "cuts")
    rows = rows.join(F.broadcast(side) if total <= MOST_CUTS else side, "_part")
    rows = rows.withColumn("at", _last_at_most(F.col("cuts"), key, max(r.n for r in found).bit_length()))
    return rows.select("doc_id", "text", "hash", (F.col("start") + F.col("at")).alias("run"), F.lit(total).cast("long").alias("runs"), (F.get("cuts", "at") == key).alias("is_first"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, pos, ghost, doc_id, text, next): each document with the text of the next by doc_id, the last with that of the first.

    Rows of a run lie in one partition. A ghost is the next run's first document once more.
    Ties of doc_id are in order of a hash of the text; null ids come first; a null text counts as empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = _with_runs(rows)
    own, ghost = F.struct("run", F.lit(False).alias("ghost")), F.struct(F.pmod(F.col("run") - 1, F.col("runs")).alias("run"), F.lit(True).alias("ghost"))
    rows = rows.select("doc_id", "text", "hash", F.explode(F.when(F.col("is_first"), F.array(own, ghost)).otherwise(F.array(own))).alias("r"))
    rows = rows.select("r.run", "r.ghost", "doc_id", "hash", "text").repartition("run")
    w = Window.partitionBy("run").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "hash")
    return rows.select("run", F.row_number().over(w).alias("pos"), "ghost", "doc_id", "text", F.lead("text").over(w).alias("next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next), a row for each row of docs.

    fp, edited_fp: fingerprints of the text and of the edited text, whose last n_chars // 2 code
    points are replaced by as many of the next document's first. near_edited, near_next: likeness
    of fp to edited_fp and to the next document's fp. Null texts count as empty; texts without terms
    are alike; a lone document is its own next; an empty table gives no rows; other columns are not read.
    """
    zs = [f"z{f}" for f in range(FAMILIES)]
    words = small(lexicon(docs, text_col, band).select(F.col("term").alias("_term"), *zs), BROADCAST_TERMS)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = neighbours(docs, id_col, text_col).select(
        "run", "pos", "ghost", "doc_id", n.alias("n_chars"), terms(F.col("text")).alias("own"),
        F.when(F.col("ghost"), F.lit("")).otherwise(F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))).alias("edited"),
    )
    rows = rows.withColumn("other", terms(F.col("edited")))
    hashed = lambda c: F.xxhash64(F.lit(-1), F.sort_array(c))
    about = F.struct("doc_id", "ghost", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), hashed("own").alias("whole"), hashed("other").alias("edited_whole"))
    nothing = F.lit(None).cast(about_type())
    item = lambda edited, about, term: F.struct(F.lit(edited).alias("e"), term.alias("term"), about.alias("about"))
    items = F.concat(F.array(item(False, about, F.lit(""))), F.transform("own", lambda x: item(False, nothing, x)), F.transform("other", lambda x: item(True, nothing, x)))
    rows = rows.select("run", "pos", F.explode(items).alias("i")).select("run", "pos", "i.*")
    rows = rows.join(words, F.col("term") == F.col("_term"), "left").where("z0 is not null or about is not null")
    found = rows.groupBy("run", "pos").agg(
        F.max("about").alias("about"),
        *(F.sort_array(F.collect_list(F.when(F.col("z0").isNotNull() & (F.col("e") == e), F.struct("term", *zs)))).alias(c) for e, c in ((False, "own"), (True, "other"))),
    )
    made = with_fingerprints(found.select("run", "pos", "about.*", "own", "other"), {"fp": ("own", "whole"), "edited_fp": ("other", "edited_whole")})
    made = made.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("run").orderBy("pos"))).where("not ghost")
    return made.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))


def about_type() -> str:
    return "struct<doc_id:bigint,ghost:boolean,n_chars:bigint,edited_sha256:string,whole:bigint,edited_whole:bigint>"
