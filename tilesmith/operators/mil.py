"""Attention pooling of bags of feature vectors.

A bag may be of any size: no bag is gathered in one task. What pooling needs of a bag's instances is a small state that
can be merged: the best instance of a class, and of a softmax the largest logit with the sums of weights and of weighted
vectors relative to it. Arrow batches make states, a task keeps one for each bag and class that it meets, and states are what
is shuffled. Weights are small literals.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesmith.functions import vectors

#: Numbers of states that a task holds before it hands them on.
STATE_NUMBERS = 4 << 20
#: Critical vectors of all bags are broadcast up to so many numbers, else instances are shuffled by bag.
BROADCAST_NUMBERS = 16 << 20


def _matrix(x: pa.ListArray) -> np.ndarray:
    """The vectors of a column without nulls, as rows."""
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(x), -1) if len(x) else np.empty((0, 0))


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def instance_scores(instances: DataFrame, weights: list[list[float]], bias: list[float] | None = None, features: str = "features") -> DataFrame:
    """instances with cls and score: a row for each instance and class."""
    return instances.select("*", F.posexplode(vectors.linear(features, weights, bias)).alias("cls", "score"))


def critical_instances(scored: DataFrame, value: str = "features", digits: int | None = None) -> DataFrame:
    """(bag, cls, inst, critical): of each class the instance of the highest score; ties go to the lowest id."""
    score = F.col("score") if digits is None else F.round("score", digits)
    best = F.max_by(F.struct("inst", F.col(value).alias("critical")), F.struct(score, -F.col("inst")))
    return scored.groupBy("bag", "cls").agg(best.alias("b")).select("bag", "cls", F.col("b.inst").alias("inst"), F.col("b.critical").alias("critical"))


def critical_of(instances: DataFrame, weights: list[list[float]], bias: list[float] | None = None, features: str = "features", digits: int | None = None) -> DataFrame:
    """(bag, cls, inst, critical): ``critical_instances`` of ``instance_scores`` in one pass over the vectors.

    Batches are scored as matrix products, and of each task the best instance of a bag and class goes on. Ids are numbers. Instances
    without features are passed over.
    """
    w, b = np.array(weights, np.float64).T, np.array(bias or 0.0, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def rows() -> pa.RecordBatch:
            bags, classes = zip(*held)
            scores, insts, x = zip(*held.values())
            return pa.RecordBatch.from_arrays([pa.array(bags, kind), pa.array(classes, pa.int32()), pa.array(scores, pa.float64()), pa.array(insts, pa.int64()), _lists(np.stack(x))], ["bag", "cls", "score", "inst", "critical"])

        for batch in batches:
            kind = batch.column(0).type
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            scores = x @ w + b
            scores = scores if digits is None else np.round(scores, digits)
            inst = batch.column(1).to_numpy(zero_copy_only=False)
            coded = batch.column(0).dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            names = [*coded.dictionary.to_pylist(), None]
            for c in range(scores.shape[1]):
                order = np.lexsort((inst, -scores[:, c], code))
                for i in order[np.r_[True, code[order][1:] != code[order][:-1]]].tolist():
                    key, best = (names[code[i]], c), (float(scores[i, c]), int(inst[i]), x[i])
                    if key not in held or (-best[0], best[1]) < (-held[key][0], held[key][1]):
                        held[key] = best
            if len(held) * x.shape[1] > STATE_NUMBERS:
                yield rows()
                held.clear()
        if held:
            yield rows()

    rows = instances.select("bag", F.col("inst").cast("long").alias("inst"), F.col(features).alias("features"))
    best = rows.mapInArrow(run, f"bag {dict(rows.dtypes)['bag']}, cls int, score double, inst long, critical array<double>")
    one = F.max_by(F.struct("inst", "critical"), F.struct("score", -F.col("inst"))).alias("b")
    kept = best.groupBy("bag", "cls").agg(one)
    return kept.select("bag", "cls", F.col("b.inst").cast(dict(instances.dtypes)["inst"]).alias("inst"), F.col("b.critical").alias("critical"))


def query_map(x: str, hidden: list[list[float]], query: list[list[float]] | None = None, hidden_bias: list[float] | None = None, query_bias: list[float] | None = None):
    """Linear, ReLU, Linear, Tanh; or a single linear layer without ``query``."""
    first = vectors.linear(x, hidden, hidden_bias)
    return first if query is None else vectors.tanh(vectors.linear(vectors.relu(first), query, query_bias))


def mapped_queries(instances: DataFrame, hidden: list[list[float]], query: list[list[float]], features: str = "features") -> DataFrame:
    """(bag, inst, q): ``query_map`` of every instance as matrix products over Arrow batches; null features give null."""
    first, second = np.array(hidden, np.float64).T, np.array(query, np.float64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(first))
            q = np.tanh(np.maximum(flat @ first, 0) @ second)
            ends = np.r_[0, np.cumsum(x.is_valid().to_numpy(zero_copy_only=False))] * q.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.r_[x.is_null().to_numpy(zero_copy_only=False), False]), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["bag", "inst", "q"])

    rows = instances.select("bag", "inst", features)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"bag {kinds['bag']}, inst {kinds['inst']}, q array<double>")


def value_map(x: str, weights: list[list[float]] | None = None, bias: list[float] | None = None):
    """Identity, or linear and ReLU; dropout does nothing outside training."""
    return F.col(x) if weights is None else vectors.relu(vectors.linear(x, weights, bias))


def attention(queries: DataFrame, critical: DataFrame, width: int) -> DataFrame:
    """(bag, inst, cls, logit, weight): softmax over a bag's instances of q . q_critical / sqrt(width), for each class.

    queries: (bag, inst, q). critical: (bag, cls, critical).
    """
    logit = vectors.dot("q", "critical") / F.lit(sqrt(width))
    z = queries.select("bag", "inst", "q").join(critical.select("bag", "cls", "critical"), "bag").select("bag", "inst", "cls", logit.alias("logit"))
    # logits are dealt by instance, so that a large bag is many tasks, and this exchange is read for maximum, sum and weights
    z = z.repartition("bag", "inst")
    top = z.groupBy("bag", "cls").agg(F.max("logit").alias("top"))
    bags = z.join(top, ["bag", "cls"]).groupBy("bag", "cls").agg(F.max("top").alias("top"), F.sum(F.exp(F.col("logit") - F.col("top"))).alias("whole"))
    return z.join(bags, ["bag", "cls"]).select("bag", "inst", "cls", "logit", (F.exp(F.col("logit") - F.col("top")) / F.col("whole")).alias("weight"))


class _States(dict):
    """(bag, cls) -> (top, whole, total): largest logit, sum of weights and of weighted vectors, both over exp(top)."""

    def add(self, key: tuple, top: float, whole: float, total: np.ndarray) -> None:
        if key in self:
            t, w, v = self[key]
            m = max(t, top)
            a, b = np.exp(t - m), np.exp(top - m)
            top, whole, total = m, a * w + b * whole, a * v + b * total
        self[key] = (top, whole, total)

    def taken(self, kind: pa.DataType, but: tuple | None = None) -> pa.RecordBatch:
        """Rows of all states except one, which stays."""
        keys = [k for k in self if k != but]
        top, whole, total = zip(*(self.pop(k) for k in keys))
        bags, classes = zip(*keys)
        return pa.RecordBatch.from_arrays([pa.array(bags, kind), pa.array(classes, pa.int32()), pa.array(top, pa.float64()), pa.array(whole, pa.float64()), _lists(np.stack(total))], ["bag", "cls", "top", "whole", "total"])


def _batch_states(held: _States, names: list, code: np.ndarray, cls: np.ndarray, logit: np.ndarray, vectors_of: np.ndarray, row: np.ndarray) -> None:
    """Add logits of (bag, cls), each with a row of vectors_of."""
    order = np.lexsort((cls, code))
    code, cls, logit, row = code[order], cls[order], logit[order], row[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])])
    top = np.maximum.reduceat(logit, first)
    weight = np.exp(logit - np.repeat(top, np.diff(np.r_[first, len(logit)])))
    whole = np.add.reduceat(weight, first)
    for i, (a, e) in enumerate(zip(first, np.r_[first[1:], len(logit)])):
        held.add((names[code[a]], int(cls[a])), float(top[i]), float(whole[i]), weight[a:e] @ vectors_of[row[a:e]])


def few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def attention_states(
    instances: DataFrame, critical: DataFrame, width: int, hidden: list[list[float]] | None = None, query: list[list[float]] | None = None, features: str = "features", values: list[list[float]] | None = None
) -> DataFrame:
    """(bag, cls, top, whole, total array<double>): the softmax over a bag's instances of q . critical / sqrt(width), ready to pool.

    instances: (bag, inst, features); critical: (bag, cls, critical). q is ``query_map`` of the features (hidden and
    query given) or the features themselves, what is summed ``value_map`` (values given) or the features. Vectors are
    read once; each task sends a state for each bag and class that it met, and states meet by one exchange, where they are merged one
    after another. Instances without features, and bags without a critical vector, are passed over.
    """
    first, second, third = (None if m is None else np.array(m, np.float64).T for m in (hidden, query, values))
    rows = instances.select("bag", F.col(features).alias("features")).where("features is not null")
    asked = critical.where("critical is not null").groupBy("bag").agg(F.sort_array(F.collect_list(F.struct(F.col("cls").cast("int").alias("cls"), F.col("critical").cast("array<double>").alias("critical")))).alias("asked"))
    # bags are counted by their column alone; a bag's classes are as many as the model has
    asked = F.broadcast(asked) if few(instances.select("bag").distinct(), BROADCAST_NUMBERS // max(1, 2 * width)) else asked
    kind = dict(rows.dtypes)["bag"]
    schema = f"bag {kind}, cls int, top double, whole double, total array<double>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = _States(), 0
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            q = x if first is None else x @ first
            q = q if second is None else np.tanh(np.maximum(q, 0) @ second)
            v = x if third is None else np.maximum(x @ third, 0)
            lists = b.column(2)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            pairs = lists.flatten()
            cls = pairs.field("cls").to_numpy(zero_copy_only=False)
            logit = np.einsum("ij,ij->i", q[row], _matrix(pairs.field("critical"))) / sqrt(width)
            coded = b.column(0).dictionary_encode()
            _batch_states(held, coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)[row], cls, logit, v, row)
            size = len(held) * v.shape[1]
            if size > STATE_NUMBERS:
                yield held.taken(b.column(0).type)
        if held:
            yield held.taken(b.column(0).type)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = _States(), None
        for b in batches:
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                held.add(key, b.column(2)[i].as_py(), b.column(3)[i].as_py(), b.column(4)[i].values.to_numpy())
                last = key
            if len(held) > 1:  # equal keys are together
                yield held.taken(b.column(0).type, last)
        if held:
            yield held.taken(b.column(0).type)

    states = rows.join(asked, "bag").select("bag", "features", "asked").mapInArrow(made, schema)
    return states.repartition("bag", "cls").sortWithinPartitions("bag", "cls").mapInArrow(merged, schema)


def bag_representation(states: DataFrame) -> DataFrame:
    """(bag, cls, value array<double>): the weighted mean of the value vectors that ``attention_states`` summed."""
    return states.select("bag", "cls", F.transform("total", lambda x: x / F.col("whole")).alias("value"))


def bag_scores(representation: DataFrame, kernel: list[list[list[float]]], bias: list[float] | None = None) -> DataFrame:
    """(bag, cls, score): a kernel as wide as the vector over all input classes, kernel[out][in][pos]."""
    outs = F.array(*(F.struct(F.lit(j).alias("cls"), vectors.dot("value", F.element_at(F.lit([[float(x) for x in r] for r in k]), F.col("cls") + 1)).alias("s")) for j, k in enumerate(kernel)))
    rows = representation.select("bag", F.explode(outs).alias("k")).groupBy("bag", F.col("k.cls").alias("cls")).agg(F.sum("k.s").alias("score"))
    if bias is None:
        return rows
    return rows.withColumn("score", F.col("score") + F.element_at(F.lit([float(b) for b in bias]), F.col("cls") + 1))


def milnet(instances: DataFrame, classes: list[list[float]], hidden: list[list[float]], query: list[list[float]], kernel: list[list[list[float]]], digits: int | None = None) -> dict[str, DataFrame]:
    """The whole forward pass over (bag, inst, features): scores, attention, representation and bag scores.

    The bag's score reads the vectors twice: for the critical instances, and for the states.
    """
    # only the critical instances are mapped again, not every instance once a class
    critical = critical_of(instances, classes, digits=digits)
    mapped = critical.select("bag", "cls", "inst", query_map("critical", hidden, query).alias("critical"))
    representation = bag_representation(attention_states(instances, mapped, len(query), hidden, query))
    weights = attention(mapped_queries(instances, hidden, query), mapped, len(query))
    return {"scores": instance_scores(instances, classes), "critical": critical, "attention": weights, "representation": representation, "bag": bag_scores(representation, kernel)}
