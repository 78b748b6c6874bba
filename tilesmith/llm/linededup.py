"""Line dedup by site-relative frequency.

The pages of a host are its group: a line on more than a given share of them is boilerplate
there and goes from all of them, while the same line on another host may stay. Only hashes of
lines are shuffled. A host has at most (mean distinct lines a page) / ratio boilerplate lines,
so its list is short, and joins back to the pages as one array for each host; texts
move only if the table of hosts is too large to broadcast, and AQE then splits a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import fresh, small, written

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.05
#: ... if it is on this many pages at least; with fewer, repetition says nothing.
MIN_PAGES = 5
#: Hosts beyond which the table of their lines is not broadcast.
BROADCAST_HOSTS = 20_000

NEWLINE = "\n"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and a leading www. or m.; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.lit(""))


def _lines(text: str) -> Column:
    return F.split(F.col(text), NEWLINE)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, n_pages, hashes array<long>): the boilerplate lines of each host that has any.

    A page counts once for a line, however often it repeats there; blank lines don't count. Pages
    without a host make up one group of their own.
    """
    pages = docs.select(F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    lines = F.array_distinct(F.filter(F.transform(F.split("text", NEWLINE), lambda x: F.trim(x)), lambda x: x != ""))
    seen = pages.select("host", F.explode(F.transform(lines, lambda x: F.xxhash64(x))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    often = seen.where(F.col("n") >= min_pages).join(total.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    often = often.where(F.col("n") > ratio * F.col("n_pages"))
    return often.groupBy("host", "n_pages").agg(F.sort_array(F.collect_list("line")).alias("hashes"))


def line_deduplicated(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with its text less the boilerplate lines, and n_lines, n_dropped long.

    Every row stays: a text of boilerplate only becomes empty, a null text stays null with no
    lines, an empty one has one line. Blank lines stay. Repeated rows count as pages each. A
    null host is a host. Columns n_lines and n_dropped of docs are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    own, hashes, left = (fresh(docs, x) for x in ("_host", "_hashes", "_kept"))
    found = written(boilerplate(docs, host, text, ratio, min_pages).select(F.col("host").alias(own), F.col("hashes").alias(hashes)), "boilerplate")
    rows = docs.join(small(found, BROADCAST_HOSTS), F.col(host).cast("string").eqNullSafe(F.col(own)), "left")
    kept = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains(hashes, F.xxhash64(F.trim(x))), F.lit(False)))
    rows = rows.withColumn(left, F.when(F.col(hashes).isNull(), _lines(text)).otherwise(kept))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    n_kept = F.when(F.col(text).isNull(), 0).otherwise(F.size(left)).cast("long")
    out = rows.withColumn("n_lines", n_lines).withColumn("n_dropped", n_lines - n_kept)
    out = out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join(left, NEWLINE)).otherwise(F.col(text)))
    return out.drop(own, hashes, left)


#: Trim takes spaces, as F.trim does. Documents of no host are one group.
SQL = f"""
WITH pages AS (SELECT doc_id, text, source, row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM pages),
total AS (SELECT source, count(*) AS n_pages FROM pages GROUP BY source),
often AS (
  SELECT l.source, trim(l.line) AS line FROM lines l JOIN total t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(l.line) <> '' GROUP BY l.source, trim(l.line), t.n_pages
  HAVING count(DISTINCT rid) >= {MIN_PAGES} AND count(DISTINCT rid) > {RATIO} * t.n_pages
),
marked AS (SELECT l.*, o.line IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND trim(l.line) = o.line)
SELECT p.doc_id, p.source AS host, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_dropped, 0) AS n_dropped,
       CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(m.kept, '') END AS text
FROM pages p LEFT JOIN (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY rid) m ON p.rid = m.rid
"""
