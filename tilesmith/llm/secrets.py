"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds candidates: the base kinds, and further ones that the method adds
if their ownership looks live (other vendor key forms, private key blocks, passwords in URLs, and
long mixed tokens of high entropy). A candidate's value is kept only as a hash. Hashes are
aggregated over the whole corpus by distinct repositories and distinct owners: a value that many
owners share, or several owners in many repositories, is an example that was copied widely; one that few own is a
live-looking credential, in however many repositories of a single owner it stands.
Values are joined back to their spans by hash; texts are neither shuffled nor kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import released, written

#: Base kinds, in the order in which spans of one start are listed.
BASE = ("assign", "access", "hex")
#: Kinds that the method adds.
ADDED = ("key_block", "url_password", "vendor", "entropy")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
#: A value on record with more owners than this is a widely copied example.
MOST_OWNERS = 3
#: ... and so is one of more than one owner in more repositories than this.
MOST_REPOS = 10
#: Bits a character that a token of mixed letters and digits needs.
LEAST_ENTROPY = 3.5

# re.A keeps the i flag to the letters a-z: long s and the Kelvin sign don't match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )?PRIVATE KEY-----")
URL_PASSWORD = re.compile(r"://[^\s:/@]+:([^\s:/@]{4,})@")
#: What stands before a URL's mark, in its last characters.
SCHEME = re.compile(r"[a-z][a-z0-9+.-]{0,30}\Z")
VENDOR = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in map(s.count, set(s)))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds, code points, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def added_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates of the method outside the base spans, and outside one another in order of kind."""
    found = []
    if "PRIVATE KEY-----" in text:
        found += [("key_block", m.start(), m.end(), m[0]) for m in KEY_BLOCK.finditer(text)]
    if "://" in text:
        found += [("url_password", m.start(1), m.end(1), m[1]) for m in URL_PASSWORD.finditer(text) if SCHEME.search(text, max(0, m.start() - 31), m.start())]
    found += [("vendor", m.start(), m.end(), m[0]) for m in VENDOR.finditer(text)]
    for m in TOKEN.finditer(text):
        s = m[0]
        if re.search("[0-9]", s) and re.search("[A-Za-z]", s) and entropy(s) >= LEAST_ENTROPY:
            found.append(("entropy", m.start(), m.end(), s))
    taken, high, out = [], -1, []
    for _, a, b, _ in base:  # merged where they overlap
        if a >= high:
            taken.append((a, b))
        else:
            taken[-1] = (taken[-1][0], max(b, high))
        high = max(high, b)
    for x in sorted(found, key=lambda x: (ORDER[x[0]], x[1])):
        i = bisect_left(taken, (x[1], x[2]))
        if (not i or taken[i - 1][1] <= x[1]) and (i == len(taken) or x[2] <= taken[i][0]):
            taken.insert(i, (x[1], x[2]))
            out.append(x)
    return out


FOUND = "array<struct<kind:string,start:int,end:int,value:string,base:boolean>>"


@released
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("base", pa.bool_())]))
    for b in batches:
        rows = []
        for text in b.column(3):
            text = text.as_py() or ""
            base = base_spans(text)
            added = added_spans(text, base)
            rows.append([{"kind": k, "start": a, "end": e, "value": sha256(v.encode()).hexdigest(), "base": own} for own, spans in ((True, base), (False, added)) for k, a, e, v in spans])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, kind)], ["doc_id", "repo", "owner", "found"])


def candidates(docs: DataFrame, repo: str | Column = "doc_id", owner: str | Column = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, repo, owner, found), a stored row for each row of docs, with the hashes of candidate values."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), col(repo).cast("string").alias("repo"), col(owner).cast("string").alias("owner"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_scan, f"doc_id long, repo string, owner string, found {FOUND}")
    return written(found.withColumn("rid", F.monotonically_increasing_id()), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners, n_spans) of every candidate value in the corpus.

    Distinct pairs are counted first, so that a value which a third of all rows hold is
    reduced before it meets in one task. A null repository or owner counts as one.
    """
    spans = found.select("repo", "owner", F.explode("found").alias("s")).select(F.col("s.value").alias("value"), "repo", "owner")
    spans = spans.na.fill("", ["repo", "owner"])
    owners = spans.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_spans"))
    repos = spans.select("value", "repo").distinct().groupBy("value").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value").select("value", "n_repos", "n_owners", "n_spans")


def scanned(docs: DataFrame, repo: str | Column = "doc_id", owner: str | Column = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base, n_repos, n_owners, verdict>>), a row for each row of docs.

    spans, by start, then kind as listed: all base spans, and of the method's candidates the
    live-looking ones. verdict: "copied" if more than ``most_owners`` owners hold the value in
    the corpus, or more than one in more than ``most_repos`` repositories, else "live". Null and empty texts have no spans; repeated rows are rows of one
    repository; an empty table gives no rows; other columns are not read.
    """
    found = candidates(docs, repo, owner, id_col, text_col)
    known = ownership(found)
    spans = found.select("rid", F.explode("found").alias("s")).select("rid", "s.*").join(known, "value")
    copied = (F.col("n_owners") > most_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") > most_repos))
    verdict = F.when(copied, "copied").otherwise("live")
    spans = spans.withColumn("verdict", verdict).where("base or verdict = 'live'")
    rank = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))
    row = F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end", "base", "n_repos", "n_owners", "verdict")
    by_row = spans.groupBy("rid").agg(F.array_sort(F.collect_list(row)).alias("spans"))
    plain = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x["n_repos"].alias("n_repos"), x["n_owners"].alias("n_owners"), x["verdict"].alias("verdict")))
    out = found.select("rid", "doc_id").join(by_row, "rid", "left").select("doc_id", plain.alias("spans"))
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(out.schema["spans"].dataType)))
