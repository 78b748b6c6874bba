"""Bags as folders of image files, written whole or not at all.

``tilesmith_bags`` is a Python data source for writing. Tasks write below root/_staging/job/attempt; the driver's
commit writes a journal of the attempts that count, which is the moment of commit, and then moves their folders into place. A task
that is tried again stages again, a job that fails leaves nothing, and a driver that is lost between journal and last
move leaves a journal that ``recover`` finishes: every move can be done twice.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tilesmith.sources.files import encoded

STAGING = "_staging"
JOURNAL = "journal.json"
REQUIRED = ("class_dir", "slide_name", "col", "row", "pixels")
PARENT = ("parent_col", "parent_row")


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, which must have moves that are one step, and the path in it."""
    found, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return found, inner.rstrip("/")


def _there(files: pafs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != pafs.FileType.NotFound


def _listed(files: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    return files.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))


@dataclass
class Staged(WriterCommitMessage):
    """An attempt's folder, and how many images it has of each bag."""

    attempt: str
    bags: dict[str, int] = field(default_factory=dict)


class BagSink(DataSource):
    """df.write.format("tilesmith_bags").options(tile_size=224).mode("append").save(root)

    Rows: class_dir, slide_name, col, row, pixels (tile_size squared times 3 bytes), and parent_col, parent_row for
    children of a tile of a lower magnification. Files are root/class_dir/slide_name/[parent_col_parent_row/]col_row.extension.
    Options: tile_size, extension (png, jpeg...), quality. append replaces tiles of the same place, overwrite the bags
    that come, and leaves others. A tile without pixels or names, or of another size, fails the job.
    """

    @classmethod
    def name(cls) -> str:
        return "tilesmith_bags"

    def writer(self, schema, overwrite: bool) -> BagWriter:
        missing = [c for c in REQUIRED if c not in schema.names]
        if missing:
            raise ValueError(f"bags need columns {missing}")
        return BagWriter(self.options, overwrite)


class BagWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.size, self.extension, self.quality = int(options.get("tile_size", 224)), options.get("extension", "png"), int(options.get("quality", 70))
        files, _, staging = self._staging()
        files.create_dir(staging, recursive=True)  # by the driver: a task that outlives the job can't make it again

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        files, root = _located(self.root)
        return files, root, f"{root}/{STAGING}/{self.job}"

    def _place(self, cls, slide, col, row, parent_col, parent_row) -> tuple[str, str]:
        """The bag's folder, and the file in it."""
        for name in (cls, slide):
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"{name!r} is no name of a folder")
        if col is None or row is None:
            raise ValueError(f"a tile of {cls}/{slide} has no place")
        below = f"{parent_col}_{parent_row}/" if parent_col is not None and parent_row is not None else ""
        return f"{cls}/{slide}", f"{below}{col}_{row}.{self.extension}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, _, staging = self._staging()
        out = Staged(uuid.uuid4().hex)  # another folder for each attempt
        made: set[str] = set()
        bags: Counter = Counter()

        def make(folder: str) -> None:
            if folder not in made and folder != staging:
                make(posixpath.dirname(folder))
                files.create_dir(folder, recursive=False)
                made.add(folder)

        for batch in iterator:
            names = batch.schema.names
            cols = [batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows for c in (*REQUIRED, *PARENT)]
            for cls, slide, col, row, pixels, *parent in zip(*cols):
                bag, name = self._place(cls, slide, col, row, *parent)
                if pixels is None or len(pixels) != 3 * self.size**2:
                    raise ValueError(f"tile {name} of {bag} has {len(pixels or b'')} bytes of pixels, not {3 * self.size**2}")
                path = f"{staging}/{out.attempt}/{bag}/{name}"
                make(posixpath.dirname(path))
                with files.open_output_stream(path) as f:
                    f.write(encoded(np.frombuffer(pixels, np.uint8).reshape(self.size, self.size, 3), self.extension, self.quality))
                bags[bag] += 1
        out.bags = dict(bags)
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        files, root, staging = self._staging()
        attempts = {m.attempt: sorted(m.bags) for m in messages if m and m.bags}
        if attempts:
            bags = sorted({b for own in attempts.values() for b in own})
            replaced = [b for b in bags if _there(files, f"{root}/{b}")] if self.overwrite else []
            with files.open_output_stream(f"{staging}/{JOURNAL}.tmp") as f:
                f.write(json.dumps({"attempts": attempts, "replaced": replaced}).encode())
            files.move(f"{staging}/{JOURNAL}.tmp", f"{staging}/{JOURNAL}")
            _finish(files, root, staging)
        else:
            _cleared(files, root, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        files, root, staging = self._staging()
        if not _there(files, f"{staging}/{JOURNAL}"):  # else committed: for recover
            _cleared(files, root, staging)


def _cleared(files: pafs.FileSystem, root: str, staging: str) -> None:
    for wait in (0.1, 0.3, 1, 3, 0):  # tasks that are being stopped may still add files
        try:
            if _there(files, staging):
                files.delete_dir(staging)
            break
        except OSError:
            if not wait:
                raise
            time.sleep(wait)
    above = f"{root}/{STAGING}"
    if _there(files, above) and not files.get_file_info(pafs.FileSelector(above)):
        files.delete_dir(above)


def _finish(files: pafs.FileSystem, root: str, staging: str) -> None:
    """Do what the journal says and isn't done yet. A folder moves as one if its bag isn't there, else file by file."""
    with files.open_input_stream(f"{staging}/{JOURNAL}") as f:
        journal = json.loads(f.read())
    for bag in journal["replaced"]:
        old = f"{staging}/old/{bag}"
        if not _there(files, old):
            files.create_dir(posixpath.dirname(old), recursive=True)
            files.move(f"{root}/{bag}", old)
    for attempt, bags in journal["attempts"].items():
        for bag in bags:
            source, target = f"{staging}/{attempt}/{bag}", f"{root}/{bag}"
            if not _there(files, source):
                continue
            if not _there(files, target):
                files.create_dir(posixpath.dirname(target), recursive=True)
                files.move(source, target)
                continue
            for info in _listed(files, source):
                if info.type == pafs.FileType.File:
                    to = target + info.path[len(source) :]
                    files.create_dir(posixpath.dirname(to), recursive=True)
                    files.move(info.path, to)
            files.delete_dir(source)
    _cleared(files, root, staging)


def recover(root: str, drop_unfinished: bool = False) -> list[str]:
    """Finish the commits that a lost driver left; the jobs that were finished.

    A staged job without a journal may still run, and is left alone; drop_unfinished deletes it, for when none runs.
    """
    files, inner = _located(root)
    done = []
    for info in files.get_file_info(pafs.FileSelector(f"{inner}/{STAGING}", allow_not_found=True)):
        staging = f"{inner}/{STAGING}/{info.base_name}"
        if _there(files, f"{staging}/{JOURNAL}"):
            _finish(files, inner, staging)
            done.append(info.base_name)
        elif drop_unfinished:
            _cleared(files, inner, staging)
    return sorted(done)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BagSink)


def write_bags(tiles: DataFrame, root: str, tile_size: int, extension: str = "png", quality: int = 70, overwrite: bool = False) -> None:
    """Each tile as an image file in the folder of its bag, all of them or none (see ``BagSink``). root must be shared."""
    register(tiles.sparkSession)
    rows = tiles.select(*REQUIRED, *(c for c in PARENT if c in tiles.columns))
    rows.write.format("tilesmith_bags").options(tile_size=tile_size, extension=extension, quality=quality).mode("overwrite" if overwrite else "append").save(root)
