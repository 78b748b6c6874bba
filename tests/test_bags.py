"""Bags are written whole or not at all."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tilesmith.sources import bags, files

N = 4


def tiles(spark, *places, value=7):
    rows = [(c, s, col, row, bytearray([value]) * (3 * N * N)) for c, s, col, row in places]
    return spark.createDataFrame(rows, "class_dir string, slide_name string, col int, row int, pixels binary")


def there(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def values(spark, root):
    return {(r.slide_name, r.col, r.row): r.pixels[0] for r in files.patch_images(spark, str(root)).collect()}


def test_append_and_overwrite(spark, tmp_path):
    first = tiles(spark, ("c", "s", 0, 0), ("c", "s", 1, 0), ("c", "t", 0, 0)).repartition(3)
    bags.write_bags(first, str(tmp_path), N)
    assert there(tmp_path) == ["c/s/0_0.png", "c/s/1_0.png", "c/t/0_0.png"]
    bags.write_bags(tiles(spark, ("c", "s", 1, 0), ("c", "s", 2, 0), value=9), str(tmp_path), N)
    assert values(spark, tmp_path) == {("s", 0, 0): 7, ("s", 1, 0): 9, ("s", 2, 0): 9, ("t", 0, 0): 7}
    bags.write_bags(tiles(spark, ("c", "s", 5, 5), ("d", "u", 0, 0)), f"file://{tmp_path}", N, overwrite=True)
    assert there(tmp_path) == ["c/s/5_5.png", "c/t/0_0.png", "d/u/0_0.png"]
    bags.write_bags(first.limit(0), str(tmp_path), N)
    bags.write_bags(first.limit(0), str(tmp_path), N, overwrite=True)
    assert there(tmp_path) == ["c/s/5_5.png", "c/t/0_0.png", "d/u/0_0.png"]
    assert not (tmp_path / "_staging").exists()


def test_children_lie_below_their_parent(spark, tmp_path):
    low = tiles(spark, ("c", "s", 1, 2)).withColumns({"parent_col": F.lit(None).cast("int"), "parent_row": F.lit(None).cast("int")})
    high = tiles(spark, ("c", "s", 2, 4), ("c", "s", 3, 5)).withColumns({"parent_col": F.lit(1), "parent_row": F.lit(2), "extra": F.lit("x")})
    bags.write_bags(low.unionByName(high, allowMissingColumns=True).repartition(3), str(tmp_path), N)
    assert there(tmp_path) == ["c/s/1_2.png", "c/s/1_2/2_4.png", "c/s/1_2/3_5.png"]
    assert files.patch_images(spark, str(tmp_path), "*/*/*").count() == 2


@pytest.mark.parametrize("bad", [("c", "s", 0, 1), ("c", "a/b", 0, 1), ("c", None, 0, 1), ("c", "..", 0, 1), ("c", "s", None, 1)])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, bad):
    bags.write_bags(tiles(spark, ("c", "s", 9, 9)), str(tmp_path), N)
    good = tiles(spark, *(("c", f"s{i}", 0, 0) for i in range(20)))
    wrong = tiles(spark, bad)
    if bad == ("c", "s", 0, 1):
        wrong = wrong.withColumn("pixels", F.lit(b"xyz"))
    for overwrite in (False, True):
        with pytest.raises(Exception, match="bytes of pixels|no name|no place"):
            bags.write_bags(good.union(wrong).coalesce(2), str(tmp_path), N, overwrite=overwrite)
        assert there(tmp_path) == ["c/s/9_9.png"] and not (tmp_path / "_staging").exists()


def batch(*places, pixels=bytes([7]) * (3 * N * N)):
    rows = [dict(zip(bags.REQUIRED, (*p, pixels))) for p in places]
    return pa.RecordBatch.from_pylist(rows, pa.schema([("class_dir", pa.string()), ("slide_name", pa.string()), ("col", pa.int32()), ("row", pa.int32()), ("pixels", pa.binary())]))


def writer(root, overwrite=False):
    return bags.BagWriter({"path": str(root), "tile_size": N}, overwrite)


def test_a_task_that_fails_once_leaves_its_tiles_once(tmp_path):
    w = writer(tmp_path)

    def breaks():
        yield batch(("c", "s", 0, 0), ("c", "lost", 0, 0))
        raise OSError("executor lost")

    with pytest.raises(OSError):
        w.write(breaks())
    again = w.write(iter([batch(("c", "s", 0, 0)), batch(("c", "s", 1, 0))]))
    w.write(iter([batch(("c", "s", 0, 0), ("c", "twice", 1, 0))]))  # a copy of the task that came too late to count
    other = w.write(iter([batch(("c", "s", 5, 0), ("d", "t", 0, 0))]))
    w.commit([again, other, None])
    assert there(tmp_path) == ["c/s/0_0.png", "c/s/1_0.png", "c/s/5_0.png", "d/t/0_0.png"]
    assert again.bags == {"c/s": 2}


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_commit_that_is_cut_off_is_finished(tmp_path, monkeypatch, overwrite):
    start = writer(tmp_path)
    start.commit([start.write(iter([batch(("c", "s", 0, 0), ("c", "s", 9, 9), ("e", "old", 0, 0))]))])
    want = ["c/s/0_0.png", "c/s/1_0.png", "c/s/2_0.png", "d/t/0_0.png", "e/old/0_0.png"] + ["c/s/9_9.png"] * (not overwrite)
    steps = 0
    while True:
        for k in range(3):
            bags.recover(str(tmp_path))
        reset = writer(tmp_path, True)
        reset.commit([reset.write(iter([batch(("c", "s", 0, 0), ("c", "s", 9, 9))]))])
        for p in (tmp_path / "d").rglob("*.png"):
            p.unlink()
        if (tmp_path / "d/t").exists():
            (tmp_path / "d/t").rmdir()
        w = writer(tmp_path, overwrite)
        messages = [w.write(iter([batch(("c", "s", 0, 0), ("c", "s", 1, 0))])), w.write(iter([batch(("c", "s", 2, 0), ("d", "t", 0, 0))]))]
        left = steps

        class Cut(type(bags.pafs.LocalFileSystem())):
            def move(self, a, b):
                nonlocal left
                left -= 1
                if left < 0:
                    raise OSError("driver lost")
                return super().move(a, b)

        with monkeypatch.context() as m:
            m.setattr(bags, "_located", lambda path: (Cut(), path))
            try:
                w.commit(messages)
                whole = True
            except OSError:
                w.abort(messages)
                whole = False
        journal = (tmp_path / "_staging" / w.job / bags.JOURNAL).exists()
        if steps == 0:  # before the moment of commit: nothing
            assert not journal and not (tmp_path / "_staging").exists() and there(tmp_path) == ["c/s/0_0.png", "c/s/9_9.png", "e/old/0_0.png"]
        elif not whole:
            assert journal and bags.recover(str(tmp_path)) == [w.job]
        if steps:
            assert there(tmp_path) == sorted(want) and bags.recover(str(tmp_path)) == []
        if whole:
            break
        steps += 1
    assert steps > 2


def test_recover_leaves_running_jobs(tmp_path):
    w = writer(tmp_path)
    message = w.write(iter([batch(("c", "s", 0, 0))]))
    assert bags.recover(str(tmp_path)) == [] and bags.recover(str(tmp_path / "none")) == []
    w.commit([message])
    assert there(tmp_path) == ["c/s/0_0.png"]
    w = writer(tmp_path)
    w.write(iter([batch(("c", "gone", 0, 0))]))
    bags.recover(str(tmp_path), drop_unfinished=True)
    assert there(tmp_path) == ["c/s/0_0.png"] and not (tmp_path / "_staging").exists()
    assert np.array_equal(w.size, N)
