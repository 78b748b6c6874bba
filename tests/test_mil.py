"""Attention as a mergeable state, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tilesmith.operators import mil


def numpy_pooled(x, q, critical, width):
    z = q @ critical / np.sqrt(width)
    w = np.exp(z - z.max())
    return (w / w.sum()) @ x


def frame(spark, bags, parts=3):
    rows = [(bag, 10 * i + n, v.tolist()) for n, (bag, x) in enumerate(bags.items()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "bag string, inst long, features array<float>").repartition(parts)


@pytest.mark.parametrize("numbers, batch", [(mil.STATE_NUMBERS, 1000), (1, 7)])
def test_states_equal_softmax(spark, monkeypatch, numbers, batch):
    monkeypatch.setattr(mil, "STATE_NUMBERS", numbers)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rng = np.random.default_rng(2)
        bags = {f"b{i}": rng.normal(size=(n, 4)).astype(np.float32) for i, n in enumerate((1, 2, 30, 300))}
        wc, wh, wq, wv = rng.normal(size=(2, 4)), rng.normal(size=(5, 4)), rng.normal(size=(3, 5)), rng.normal(size=(6, 4))
        df = frame(spark, bags)
        critical = mil.critical_of(df, wc.tolist(), [0.5, -1.0])
        slow = mil.critical_instances(mil.instance_scores(df, wc.tolist(), [0.5, -1.0]))
        assert {(r.bag, r.cls): (r.inst, r.critical) for r in critical.collect()} == {(r.bag, r.cls): (r.inst, r.critical) for r in slow.collect()}
        mapped = critical.select("bag", "cls", mil.query_map("critical", wh.tolist(), wq.tolist()).alias("critical"))
        own = mil.bag_representation(mil.attention_states(df, mapped, 3, wh.tolist(), wq.tolist()))
        valued = mil.bag_representation(mil.attention_states(df, mapped, 3, wh.tolist(), wq.tolist(), values=wv.tolist()))
        plain = mil.bag_representation(mil.attention_states(df, critical, 4))
        got = [{(r.bag, r.cls): r.value for r in out.collect()} for out in (own, valued, plain)]
        assert all(len(g) == 8 for g in got)
        for bag, x in bags.items():
            x = x.astype(float)
            q = np.tanh(np.maximum(x @ wh.T, 0) @ wq.T)
            for c in range(2):
                i = (x @ wc[c]).argmax()
                want = (numpy_pooled(x, q, q[i], 3), numpy_pooled(np.maximum(x @ wv.T, 0), q, q[i], 3), numpy_pooled(x, x, x[i], 4))
                for g, w in zip(got, want):
                    assert g[bag, c] == pytest.approx(w.tolist())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_logits_and_missing_features(spark):
    rows = [("a", 1, [1000.0, 0.0]), ("a", 2, [-1000.0, 3.0]), ("a", 3, None), ("none", 4, None), (None, 5, [1.0, 1.0]), ("tie", 7, [2.0, 2.0]), ("tie", 6, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "bag string, inst long, features array<double>").repartition(5)
    critical = mil.critical_of(df, [[1.0, 0.0], [0.0, 1.0]])
    assert {(r.bag, r.cls): r.inst for r in critical.where("bag is not null").collect()} == {("a", 0): 1, ("a", 1): 2, ("tie", 0): 6, ("tie", 1): 6}
    got = {(r.bag, r.cls): r.value for r in mil.bag_representation(mil.attention_states(df, critical, 2)).collect()}
    assert got == {("a", 0): [1000.0, 0.0], ("a", 1): [-1000.0, 3.0], ("tie", 0): [2.0, 2.0], ("tie", 1): [2.0, 2.0]}
    assert mil.attention_states(df.limit(0), critical, 2).count() == 0


def test_a_bag_of_a_million_instances(spark):
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 1000 == 7, F.lit("small")).otherwise("large").alias("bag"), F.col("id").alias("inst"), F.array(*(((F.col("id") * k) % 101 / 50 - 1).cast("float") for k in (3, 7, 11))).alias("features"))
    states = mil.attention_states(rows, mil.critical_of(rows, [[1.0, 0.5, 0.25]]), 3)
    i = np.arange(n)
    x = np.stack([(i * k) % 101 / 50 - 1 for k in (3, 7, 11)], 1).astype(np.float32).astype(float)
    got = {r.bag: (r.value, r.whole) for r in states.select("bag", "whole", F.transform("total", lambda v: v / F.col("whole")).alias("value")).collect()}
    for bag, own in (("small", x[i % 1000 == 7]), ("large", x[i % 1000 != 7])):
        best = own[np.round(own @ [1.0, 0.5, 0.25], 12).argmax()]
        assert got[bag][0] == pytest.approx(numpy_pooled(own, own, best, 3).tolist())
    # what is shuffled: a state for each task, bag and class; no vector of an instance
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan.lower() and plan.count("Exchange hashpartitioning(bag") <= 5


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mil, "BROADCAST_NUMBERS", 0)
    df = frame(spark, {"a": np.eye(3), "b": 2 * np.eye(3)})
    critical = mil.critical_of(df, [[1.0, 0.0, 0.0]])
    a = {r.bag: r.value for r in mil.bag_representation(mil.attention_states(df, critical, 3)).collect()}
    w = np.exp([1 / np.sqrt(3), 0, 0])
    assert a["a"] == pytest.approx((w / w.sum()).tolist())
