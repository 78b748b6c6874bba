"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; the unlabelled set is web text of unknown quality. A
small network minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with logistic loss, so its output estimates the chance that a text is good. No labelled negative
enters the risk. The class prior is estimated from positives and unlabelled rows alone: a network of the same form tells
the two apart, so that its odds estimate the ratio of their densities, which is 1 / prior where all texts are good. Features
come from the text alone, in one pass over all rows that is stored, and their mean and scale are those of all rows; the fits
run on two bounded samples of them on the driver, scoring on all rows.

A fit takes the same number of steps whatever the size of the samples, and noise is added to its inputs, so that it learns no row by
heart. Texts are dealt into folds by their hash, and each fold is scored by a network that was fitted on the others: an unlabelled
text counts as negative evidence in the fit, and must not be its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import dropped, released, small, written

#: Bounds of the two samples that the classifier is fitted on: rows labelled good, rows without label.
POSITIVES = 20_000
UNLABELLED = 40_000
#: A score from here on is accepted.
THRESHOLD = 0.3
HIDDEN = 32
STEPS = 150
BATCH = 1024
#: Standard deviation of the noise on each standardised input while fitting.
NOISE = 0.5
#: Parts of the texts that are scored by a network each.
FOLDS = 4
#: Steps and batch of a network that the prior is estimated with, and how often positives are halved anew.
PRIOR_STEPS = 200
PRIOR_BATCH = 512
PRIOR_SPLITS = 4
#: Characters whose share of the text is a feature of its own.
MARKS = b"!?.,;:|*$%&#@<>{}[]()=+/\\\"'_-~^`"
N_FEATURES = 26 + len(MARKS)


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a text; all 0 but finite for a null or empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    b = (text or "").encode()
    w = b.split()
    if not w:
        return out
    h = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    n, m = len(b), len(w)
    lens = np.fromiter(map(len, w), np.int64, m)
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper, lower = h[65:91].sum(), h[97:123].sum()
    rest = w[1:]
    counts = Counter(w)
    out[:26] = (
        1, np.log1p(n), np.log1p(m), upper / n, lower / n, h[48:58].sum() / n, h[128:].sum() / n, h[32] / n, h[10] / n, upper / (upper + lower + 1),
        lens.mean(), lens.std(), np.log1p(lens.max()), len(counts) / m, max(counts.values()) / m, sum(map(eq, w, rest)) / m, len(set(zip(w, rest))) / m, sum(map(bytes.isupper, w)) / m,
        (lens == 1).mean(), (lens > 15).mean(), np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".?!" for x in lines) / len(lines),
        sum(v for v in counts.values() if v > 1) / m, sum(len(k) * (v - 1) for k, v in counts.items()) / n,
    )
    out[26:] = np.sqrt(h[np.frombuffer(MARKS, np.uint8)] / n)
    return out


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, features, row), a stored row with a number of its own for each row of docs."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.stack([features(t.as_py()) for t in b.column(2)]) if b.num_rows else np.zeros((0, N_FEATURES), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, N_FEATURES, dtype=np.int32)), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "text_hash", "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(run, "doc_id long, text_hash long, features array<float>")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "features")


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature over all rows; sums are decimal, so their order tells nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(range(N_FEATURES), pa.int32()), pa.array(x.sum(0)), pa.array((x * x).sum(0))], ["i", "s", "q"])

    sums = rows.select("features").mapInArrow(run, "i int, s double, q double").groupBy("i")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38, 8)")).cast("double").alias(c)
    got = np.array([(r.s, r.q) for r in sums.agg(exact("s"), exact("q")).orderBy("i").collect()]).reshape(-1, 2) / max(1, rows.count())
    return got[:, 0], np.sqrt(np.maximum(got[:, 1] - got[:, 0] ** 2, 0))


class Model:
    """One hidden layer on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]) -> None:
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(self.inputs(x) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def risk(weights: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """The non-negative risk of positive and unlabelled inputs, its inner term, and the gradient that is descended.

    Where the inner term is below 0, the gradient is that of its negative.
    """
    w1, b1, w2, b2 = weights
    x, n, m = np.concatenate([p, u]), len(p), len(u)
    hid = np.tanh(x @ w1 + b1)
    z = hid @ w2 + b2
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = np.logaddexp(0, z)  # loss(-); its slope is s, that of loss(+) is s - 1
    inner = soft[n:].mean() - prior * soft[:n].mean()
    plus = prior * (soft[:n] - z[:n]).mean()
    if inner >= 0:
        g = np.concatenate([prior * (s[:n] - 1 - s[:n]) / n, s[n:] / m])
    else:
        g = np.concatenate([prior * s[:n] / n, -s[n:] / m])
    return plus + max(0.0, inner), inner, _back(x, hid, w2, g)


def apart(weights: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float = 0.5) -> tuple[float, float, list[np.ndarray]]:
    """Logistic loss of telling positive from unlabelled inputs, both of one weight, and its gradient."""
    w1, b1, w2, b2 = weights
    x, n, m = np.concatenate([p, u]), len(p), len(u)
    hid = np.tanh(x @ w1 + b1)
    z = hid @ w2 + b2
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = np.logaddexp(0, z)
    loss = (soft[:n] - z[:n]).mean() / 2 + soft[n:].mean() / 2
    return loss, loss, _back(x, hid, w2, np.concatenate([(s[:n] - 1) / (2 * n), s[n:] / (2 * m)]))


def _back(x: np.ndarray, hid: np.ndarray, w2: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
    gh = np.outer(g, w2) * (1 - hid**2)
    return [x.T @ gh, gh.sum(0), hid.T @ g, np.array([g.sum()])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray, seed: int = 0, steps: int = STEPS, loss=risk, batch: int = BATCH) -> Model:
    """Minimise the loss, by default the non-negative risk, by Adam with a little weight decay and noise on the inputs."""
    rng = np.random.default_rng(seed)
    k = positive.shape[1]
    weights = [rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model = Model(mean, scale + 1e-3, [w.astype(np.float32) for w in weights])
    xp, xu = (model.inputs(x.astype(np.float64)).astype(np.float32) for x in (positive, unlabelled))
    first, second = ([np.zeros_like(w) for w in model.weights] for _ in range(2))
    for step in range(1, steps + 1):
        p, u = (x[rng.integers(0, len(x), batch)] + np.float32(NOISE) * rng.standard_normal((batch, k), np.float32) for x in (xp, xu))
        grads = loss(model.weights, p, u, prior)[2]
        for i in (0, 2):
            grads[i] = grads[i] + 1e-4 * model.weights[i]
        rate = 0.01 * (1 - step / (steps + 1))
        for w, d, a, b in zip(model.weights, grads, first, second):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


class Folds:
    """A network for each fold of the texts, fitted on the others; where these have no trusted or no unlabelled row, on all."""

    def __init__(self, trusted: np.ndarray, web: np.ndarray, fold_of_trusted: np.ndarray, fold_of_web: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
        self.prior = estimated_prior(trusted, web, mean, scale)
        self.models = []
        for k in range(FOLDS):
            own = [x[of != k] if (fold_of_trusted != k).any() and (fold_of_web != k).any() else x for x, of in ((trusted, fold_of_trusted), (web, fold_of_web))]
            self.models.append(fit(*own, self.prior, mean, scale, seed=k))

    def scores(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for k, model in enumerate(self.models):
            out[fold == k] = model.scores(x[fold == k])
        return out


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    """Share of good texts among unlabelled rows: 1 / the ratio of densities at positives.

    Each half of the positives trains a network; the median log ratio is taken at both halves and averaged, since overfit raises
    it at those seen as it lowers it at the others. Several random halvings are averaged, so that the order of rows tells little.
    """
    seen = []
    for split in range(PRIOR_SPLITS):
        order = np.random.default_rng(split).permutation(len(positive))
        halves = [positive[order[::2]], positive[order[1::2]]] if len(positive) > 1 else [positive]
        for own in halves:
            model = fit(own, unlabelled, 0.5, mean, scale, seed=1 + split, steps=PRIOR_STEPS, loss=apart, batch=PRIOR_BATCH)
            seen += [np.median(model.logits(x)) for x in halves]
    return float(np.clip(np.exp(-np.mean(seen)), 0.02, 0.98))


def _held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fold() -> F.Column:
    """By the text's hash; texts without words, which have the same features, are together."""
    return F.when(F.col("features")[0] > 0, F.pmod("text_hash", F.lit(FOLDS))).otherwise(0).cast("int")


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` rows' features and folds: those of the smallest hashes of id and text, and of their number for rows that
    repeat both, so that these are drawn one by one and no other draw depends on how the table is laid out.

    Hashes are cut off first where about 1.2 times as many rows are expected, so that the tasks
    don't send ``most`` rows each.
    """
    n = rows.count()
    again = rows.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    again = small(written(again, "again"))
    rows = rows.join(again, rows["doc_id"].eqNullSafe(again["_id"]) & (rows["text_hash"] == again["_hash"]), "left")
    salt = F.when(F.col("_hash").isNotNull(), F.col("row")).otherwise(F.lit(-1))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "text_hash", salt), 11))
    if n > most:
        rows = rows.where(F.col("h") < int(min(1, (1.2 * most + 500) / n) * 2**53))
    got = rows.orderBy("h").limit(most).select("features", _fold().alias("fold")).toArrow().combine_chunks()
    return got["features"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES), got["fold"].to_numpy()


def learn(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Folds | None:
    """The classifier from stored features; None without a row labelled good or without unlabelled rows.

    Of labels (doc_id, quality) only those of rows that aren't held out are read; several
    labels of a document count as good if one is; nulls are passed over. Unlabelled are all rows
    that aren't held out, sampled without looking at whether they have a label. Labels that aren't good are not used.
    """
    own = labels.where("doc_id is not null and quality is not null").where(~_held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = written(own, "labels")
    mean, scale = moments(rows)
    rows = rows.where(~_held_out())
    trusted, fold_of_trusted = _sample(rows.join(own.where("quality > 0").select("doc_id"), "doc_id", "left_semi"), positives)
    web, fold_of_web = _sample(rows, unlabelled)
    dropped(own)
    if not len(trusted) or not len(web):
        return None
    return Folds(trusted, web, fold_of_trusted, fold_of_web, mean, scale)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted), a row for each row of docs.

    The score uses the text alone: equal texts have equal scores, null and empty ones that
    of no features. Without anything to learn from, every score is 0.5. A null doc_id isn't held
    out. An empty table gives no rows; columns beside doc_id, text and quality aren't read.
    """
    rows = featured(docs)
    model = learn(rows, labels)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, N_FEATURES)
            s = model.scores(x, np.where(x[:, 0] > 0, b.column(1).to_numpy() % FOLDS, 0)) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float64))], ["doc_id", "text_hash", "score"])

    out = rows.mapInArrow(run, "doc_id long, text_hash long, score double")
    return out.select("doc_id", "text_hash", _held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects; each row is judged by its own text."""
    bad = scored(docs, labels, threshold).where("predicted = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = small(written(bad, "rejected"))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti").select(docs.columns)
