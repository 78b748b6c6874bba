"""Queries opN_<name> of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesmith.llm import bpe, decontam, imatch, importance, linededup, lmscore, pii, quality, runs, secrets, sharding, simhash, warc
from tilesmith.llm.common import scratch_path, table


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    rows = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic; background: all others."""
    docs, target = lmscore.labelled_target(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return lmscore.scored(docs, target)


#: Vocabulary of op3: one for many languages.
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def token_digests(docs: DataFrame) -> DataFrame:
    """Encoded, decoded, and both as hashes."""
    path = public_tokenizers.path(BPE_RANKS)
    rows = bpe.decoded(bpe.encoded(docs, path, public_tokenizers.PATTERN), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; a null one is empty, with no ids and the hash of nothing. Repeated rows are rows each, an empty table gives none."""
    return token_digests(table(spark, sf_dir, "documents"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a repository, its source the owner. counts: repositories and owners of each span's value."""
    rows = secrets.scanned(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    n = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    live = F.size(F.filter("spans", lambda x: x["verdict"] == "live")).cast("long").alias("n_live")
    counts = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["n_repos"].cast("string"), x["n_owners"].cast("string"))), ",").alias("counts")
    return rows.select("doc_id", *map(n, secrets.BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), live, (F.size("spans") - live).cast("long").alias("n_copied"), counts)


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts alone are scored; null and empty ones have one score. Rows of a null doc_id aren't held out; without labels all scores are 0.5."""
    rows = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return rows.select("doc_id", "held_out", "score", "predicted")


def op6_decontamination_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of every benchmark item, against all documents."""
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit_at").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_at") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next is by doc_id, and rows of one id by their text's hash; a null text is empty, a table of one row is its own next."""
    rows = imatch.fingerprints(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", imatch.told(F.col("fp")).alias("fingerprint"), imatch.told(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


#: Of the query only: callers bring their own secret.
PII_KEY = b"key of the registered query"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text with surrogates; a null text stays null, one without entities stays as it is. kinds: of each mention, in the text's order."""
    rows = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return rows.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))


def op9_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on over 5 % of a source's documents go from them."""
    rows = linededup.line_deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("source").alias("host"), "n_lines", "n_dropped", "text")


def op10_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, links of at most 3 bits, over all documents."""
    rows = simhash.simhash_groups(table(spark, sf_dir, "documents"), k=3, radius=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more; of every tenth document, by the CRC of its id, the end is made periodic first. A null id's is not."""
    docs = runs.echoed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = runs.periodic_runs(docs, least=12)
    first = F.col("longest")
    milli = F.floor(1000 * first["length"] / first["period"]).cast("long").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", *(first[c].alias(c) for c in ("start", "length", "period")), milli, "runs_sha256", "collapsed_sha256")


def op12_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, and read back."""
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, least=0)
    rows = warc.resolved(warc.read_warc(spark, path, payloads=False))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_importance_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single words, the benchmark as target; a tenth of the documents of 20 words or more is drawn."""
    rows = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most_words=1, buckets=10_000, min_words=20, percent=10, seed=2024)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_kd_sharding, op2_lm_cross_entropy, op3_byte_bpe, op4_secret_ownership, op5_quality_pu, op6_decontamination_index, op7_imatch, op8_pii_surrogates, op9_site_line_dedup, op10_simhash_bk_trees, op11_suffix_tree_runs, op12_warc_segments, op13_importance_tries)}
ORACLE: dict[str, str] = {"op9_site_line_dedup": linededup.SQL, "op12_warc_segments": warc.SQL, "op13_importance_tries": importance.SQL}
