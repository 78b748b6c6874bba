"""Bags that complete over batches, restarts and repeats."""

import time

import pytest
from tilesmith.streaming import bags

SCHEMA = "slide string, n_tiles int, tile int"


class Feed:
    """Files of a stream, one a call, and the table of what came out."""

    def __init__(self, spark, root, stall=None):
        self.spark, self.root, self.stall, self.n = spark, root, stall, 0

    def __call__(self, *rows):
        self.n += 1
        if rows:
            self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        out = bags.ingest_bags(stream, f"{self.root}/out", f"{self.root}/state", self.stall)
        return sorted(map(tuple, out.collect()))


def test_bags_complete_once_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    assert feed(("a", 3, 2), ("b", 2, 0), ("a", 3, 2), ("one", 1, 0)) == [("one", 1, 1, "whole")]
    assert feed() == [("one", 1, 1, "whole")]
    assert feed(("a", 3, 0), ("one", 1, 0), ("c", 20, 19), (None, 2, 0), ("d", None, 0), ("e", 2, None), ("none", 0, 0)) == [("one", 1, 1, "whole")]
    got = feed(("a", 3, 1), ("b", 2, 1), ("a", 3, 1))
    assert got == [("a", 3, 3, "whole"), ("b", 2, 2, "whole"), ("one", 1, 1, "whole")]
    rest = [("c", 20, i) for i in range(19)] + [("c", 20, 3)]
    assert feed(*rest[::-1]) == sorted([*got, ("c", 20, 20, "whole")]) == feed(*rest, ("a", 3, 0))


def test_tiles_out_of_range_stop_the_stream(spark, tmp_path):
    with pytest.raises(Exception, match="has 2 tiles, and not number 5"):
        Feed(spark, tmp_path)(("a", 2, 5))


def test_stalled_bags_are_told_and_go_on(spark, tmp_path):
    feed = Feed(spark, tmp_path, stall=1.0)
    feed(("slow", 3, 0), ("done", 1, 0))
    time.sleep(2)
    feed(("other", 9, 0))
    got = feed(("other", 9, 1))
    assert ("slow", 3, 1, "stalled") in got and ("done", 1, 1, "whole") in got and not any(r[0] == "done" and r[3] == "stalled" for r in got)
    got = feed(("slow", 3, 1), ("slow", 3, 2))
    assert ("slow", 3, 3, "whole") in got and sum(r[0] == "slow" and r[3] == "whole" for r in got) == 1


def test_the_session_keeps_its_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with bags.state_store(spark):
        assert spark.conf.get(key) == bags.STORE
    assert spark.conf.get(key) == before
