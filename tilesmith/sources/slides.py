"""Slides: discovery, and reading of tiles through a Python data source.

Backends open a slide and read regions. The synthetic one makes pixels by a formula and needs
no library; the one for real slides is used where openslide can be imported. A backend of one's own is named as
"module:Class".
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilesmith.functions import paths
from tilesmith.functions.images import edge_value, resized

SLIDES = ("svs", "ndpi")


def discovered(spark: SparkSession, input_dir: str, extensions: tuple[str, ...] = SLIDES) -> DataFrame:
    """(path, length, class_dir, slide_name) of all slides below a directory, each once; contents are not read.

    Extensions are case-sensitive; names that start with a dot or underscore are hidden, as Spark hides them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(input_dir)
    return files.select("path", "length", paths.parent("path").alias("class_dir"), paths.slide_name("path").alias("slide_name"))


def checked(slides: DataFrame) -> DataFrame:
    """The slides; refuses none at all, and two of one name in a class, whose tiles would mix."""
    if slides.isEmpty():
        raise FileNotFoundError("no slides found")
    twice = slides.groupBy("class_dir", "slide_name").count().where("count > 1").first()
    if twice:
        raise ValueError(f"several slides are named {twice.slide_name!r} in {twice.class_dir!r}")
    return slides


class SlideBackend(Protocol):
    def describe(self, path: str) -> tuple[int, int, dict[str, str]]: ...

    def region(self, path: str, depth: int, x: int, y: int, w: int, h: int, offset_x: int = 0, offset_y: int = 0) -> np.ndarray: ...


class SyntheticBackend:
    """Slides by formula: a checkered disc on white, its size from a hash of the path."""

    def describe(self, path: str) -> tuple[int, int, dict[str, str]]:
        d = hashlib.sha256(path.encode()).digest()
        return 600 + 4 * d[0], 500 + 4 * d[1], {"openslide.objective-power": "40"} if d[2] % 4 else {}

    def region(self, path: str, depth: int, x: int, y: int, w: int, h: int, offset_x: int = 0, offset_y: int = 0) -> np.ndarray:
        if "broken" in path:
            raise OSError("unreadable region")
        width, height, _ = self.describe(path)
        xx = (np.arange(x, x + w)[None, :] + 0.5) * 2**depth + offset_x
        yy = (np.arange(y, y + h)[:, None] + 0.5) * 2**depth + offset_y
        inside = ((xx - width / 2) / (0.4 * width)) ** 2 + ((yy - height / 2) / (0.4 * height)) ** 2 < 1
        check = (((xx // 8 % 2 != yy // 8 % 2) * 120) + 60).astype(np.uint8)
        out = np.full((h, w, 3), 255, np.uint8)
        for b in range(3):
            np.copyto(out[..., b], check + np.uint8(10 * b), where=inside)
        return out


class OpenSlideBackend:
    """Real slides; needs openslide on the executors."""

    opened: tuple = (None, None)

    def _open(self, path: str):
        try:
            import openslide
        except ImportError as e:
            raise ImportError("reading real slides needs openslide on the executors") from e
        if self.opened[0] != path:  # neighbouring tiles are read through one handle
            self.opened = (path, openslide.OpenSlide(path.removeprefix("file:")))
        return self.opened[1]

    def describe(self, path: str) -> tuple[int, int, dict[str, str]]:
        s = self._open(path)
        return *s.dimensions, dict(s.properties)

    def region(self, path: str, depth: int, x: int, y: int, w: int, h: int, offset_x: int = 0, offset_y: int = 0) -> np.ndarray:
        s, f = self._open(path), 2**depth
        level = s.get_best_level_for_downsample(f)
        d = s.level_downsamples[level]
        own = s.read_region((x * f + offset_x, y * f + offset_y), level, (round(w * f / d), round(h * f / d))).convert("RGB")
        return resized(np.asarray(own), h, w)

    def associated(self, path: str) -> Iterator[tuple[str, np.ndarray]]:
        for name, image in self._open(path).associated_images.items():
            yield name, np.asarray(image.convert("RGB"))


BACKENDS = {"synthetic": SyntheticBackend, "openslide": OpenSlideBackend}


def opened(backend: str) -> SlideBackend:
    if backend in BACKENDS:
        return BACKENDS[backend]()
    module, _, name = backend.partition(":")
    if not name:
        raise ValueError(f"unknown backend {backend!r}: use one of {sorted(BACKENDS)} or module:Class")
    return getattr(importlib.import_module(module), name)()


def described(slides: DataFrame, backend: str = "synthetic") -> DataFrame:
    """slides with width, height and properties, and error where a slide can't be opened; others go on. Each row is opened where it is."""
    keep = [c for c in slides.columns if c not in ("width", "height", "properties", "error")]
    at, rest = keep.index("path"), slides.select(*keep)
    added = "width int, height int, properties map<string,string>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = opened(backend)
        for b in batches:
            rows = []
            for path in b.column(at).to_pylist():
                try:
                    w, h, props = reader.describe(path)
                    rows.append((w, h, list(props.items()), None))
                except ImportError:
                    raise
                except Exception as e:  # one damaged slide must not stop the others
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds))], [*keep, "width", "height", "properties", "error"])

    return rest.mapInArrow(run, T.StructType([*rest.schema, *T.StructType.fromDDL(added)]))


def associated_images(slides: DataFrame, backend: str = "synthetic") -> DataFrame:
    """A row for each image that a slide has beside its levels (label, macro, ...): the columns of slides, with image, width, height, pixels (RGB) and error.

    Images are read one by one where the slide's row is. A slide without any has no row; one that can't be read has a row with
    an error, after the images that came before it. A backend without ``associated`` has none.
    """
    added = "image string, width int, height int, pixels binary, error string"
    new = [f.name for f in T.StructType.fromDDL(added)]
    keep = [c for c in slides.columns if c not in new]
    at, rest = keep.index("path"), slides.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = opened(backend)
        images = getattr(reader, "associated", lambda path: ())
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

        def told(row: pa.RecordBatch, *values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*row.columns, *(pa.array([v], k) for v, k in zip(values, kinds))], [*keep, *new])

        for b in batches:
            for i, path in enumerate(b.column(at).to_pylist()):
                try:
                    for name, rgb in images(path):
                        yield told(b.slice(i, 1), name, rgb.shape[1], rgb.shape[0], rgb.tobytes(), None)
                except ImportError:
                    raise
                except Exception as e:  # as in described
                    yield told(b.slice(i, 1), None, None, None, None, f"{type(e).__name__}: {e}")

    return rest.mapInArrow(run, T.StructType([*rest.schema, *T.StructType.fromDDL(added)]))


def read_tiles(grid: DataFrame, backend: str = "synthetic", tile_size: int = 224, threshold: float | None = None, block: int = 16) -> DataFrame:
    """grid (with path, depth, x0, y0, w, h) with pixels, edge and error.

    Tiles of neighbouring rows of a slide go to one task, so that a slide is read by many tasks and
    each opens it seldom. The edge score is of the tile as read, the pixels are brought to
    tile_size squared. Under a threshold, tiles at or below it are dropped here, before any pixel leaves the
    worker. A tile that can't be read keeps its row, with an error. Of a ``bounded`` slide, tiles count from its offset.
    """
    keep = [c for c in grid.columns if c not in ("pixels", "edge", "error")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.select(*keep).schema.fields)
    ix = [keep.index(c) for c in ("path", "depth", "x0", "y0", "w", "h", *(c for c in ("offset_x", "offset_y") if {"offset_x", "offset_y"} <= set(keep)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = opened(backend)
        for b in batches:
            pick, pixels, scores, errors = [], [], [], []
            for i, at in enumerate(zip(*(b.column(j).to_pylist() for j in ix))):
                try:
                    region = reader.region(*at)
                    edge = edge_value(region, tile_size)
                    if threshold is not None and edge <= threshold:
                        continue
                    out = (resized(region, tile_size, tile_size).tobytes(), edge, None)
                except ImportError:
                    raise
                except Exception as e:
                    out = (None, None, f"{type(e).__name__}: {e}")
                pick.append(i)
                for x, v in zip((pixels, scores, errors), out):
                    x.append(v)
            own = b.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pixels, pa.binary()), pa.array(scores, pa.float64()), pa.array(errors, pa.string())], [*keep, "pixels", "edge", "error"])

    dealt = grid.select(*keep).repartition("path", F.expr(f"row div {block}"))
    return dealt.mapInArrow(run, f"{kinds}, pixels binary, edge double, error string")


@dataclass
class _Block:
    """Rows of tiles of one level of a slide: its size and offset are known from planning."""

    path: str
    depth: int
    rows: range
    size: tuple[int, int]
    offset: tuple[int, int]


class _Tiles(InputPartition):
    def __init__(self, blocks: list[_Block]) -> None:
        self.blocks = blocks


class TileSource(DataSource):
    """spark.read.format("tilesmith_tiles"): the tiles of levels of slides, by blocks of rows; small blocks share a partition.

    A task costs more than a few tiles do, so partitions hold more blocks where there are many: their number stays about at the option
    partitions, however many slides there are. Tiles leave the worker in batches of about BATCH_BYTES of pixels.

    Options: described, a Parquet table of (path, width, height) with offset_x and offset_y if slides are ``bounded`` (see
    ``described`` and ``tiling.with_bounds``), so that planning opens no slide; or paths, separated by ;, which the driver opens
    and cuts down to their bounds (bounds=false: not). depths (a comma between), tile_size, block (rows of tiles
    in a block), tiles (of a partition, at least, if there are so many), partitions (about as many at most, but for large blocks), backend.

    rows and cols ("2:5", either end may be missing), depths and above (tiles of an edge score over it, and those that can't be
    read) say what to read: nothing else is planned or read, and no pixel of other tiles leaves the worker. They are options and not
    pushed filters, because Spark keeps what was pushed last with the relation, so that two filters of one DataFrame would both
    read the rows of one. Filters on top are right as ever, after reading. Slides with an error or without a size in the table give
    no tile; a tile that can't be read has an error.
    """

    @classmethod
    def name(cls) -> str:
        return "tilesmith_tiles"

    def schema(self) -> str:
        return "path string, depth int, col int, row int, pixels binary, edge double, error string"

    def reader(self, schema) -> DataSourceReader:
        return TileReader(self.options)


def _within(wanted: str | None, n: int) -> range:
    """The numbers below n of a slice "a:b"."""
    first, colon, last = (wanted or ":").partition(":")
    if not colon:
        raise ValueError(f"{wanted!r} is no range: write first:end")
    return range(n)[int(first) if first.strip() else None : int(last) if last.strip() else None]


#: What leaves a worker at once, in bytes of pixels and in tiles.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 10_000
KINDS = {"path": pa.string(), "depth": pa.int32(), "col": pa.int32(), "row": pa.int32(), "pixels": pa.binary(), "edge": pa.float64(), "error": pa.string()}


def _batch(tiles: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*tiles), KINDS.values())], list(KINDS))


class TileReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = [p for p in options.get("paths", "").split(";") if p]
        self.described = options.get("described")
        self.depths = [int(x) for x in str(options.get("depths", options.get("depth", 0))).split(",")]
        self.size, self.block = (int(options.get(k, d)) for k, d in (("tile_size", 224), ("block", 4)))
        self.tiles, self.most = int(options.get("tiles", 32)), int(options.get("partitions", 1000))
        self.backend, self.bounds = options.get("backend", "synthetic"), options.get("bounds", "true").lower() != "false"
        self.rows, self.cols = options.get("rows"), options.get("cols")
        self.above = float(options["above"]) if "above" in options else None

    def _slides(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(path, width, height, offset_x, offset_y)."""
        if self.described:
            import pyarrow.dataset as ds

            table = ds.dataset(self.described)
            names = ["path", "width", "height", *(c for c in ("offset_x", "offset_y", "error") if c in table.schema.names)]
            for b in table.to_batches(columns=names):
                for r in b.to_pylist():
                    if r["path"] is not None and r["width"] and r["height"] and r.get("error") is None:
                        yield r["path"], r["width"], r["height"], r.get("offset_x") or 0, r.get("offset_y") or 0
            return
        reader = opened(self.backend)
        for p in self.paths:
            w, h, props = reader.describe(p)
            own = [int(props.get(f"openslide.bounds-{k}", d)) for k, d in (("width", w), ("height", h), ("x", 0), ("y", 0))] if self.bounds else [w, h, 0, 0]
            yield p, *own

    def _blocks(self) -> Iterator[tuple[_Block, int]]:
        """Blocks, and how many tiles each has."""
        for path, w, h, x, y in self._slides():
            for d in self.depths:
                size = ceil(w / 2**d), ceil(h / 2**d)
                rows, cols = _within(self.rows, ceil(size[1] / self.size)), _within(self.cols, ceil(size[0] / self.size))
                for i in range(0, len(rows) if cols else 0, self.block):
                    own = rows[i : i + self.block]
                    yield _Block(path, d, own, size, (x, y)), len(own) * len(cols)

    def partitions(self) -> list[InputPartition]:
        out, held, n = [], [], 0
        blocks = list(self._blocks())
        least = max(self.tiles, ceil(sum(tiles for _, tiles in blocks) / self.most))
        for block, tiles in blocks:
            held.append(block)
            n += tiles
            if n >= least:
                out.append(_Tiles(held))
                held, n = [], 0
        return [*out, _Tiles(held)] if held or not out else out

    def read(self, partition: _Tiles) -> Iterator[pa.RecordBatch]:
        reader, held, size = opened(self.backend), [], 0
        for b in partition.blocks:
            for tile in self._tiles_of(reader, b):
                held.append(tile)
                size += len(tile[4] or b"")
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    def _tiles_of(self, reader: SlideBackend, b: _Block) -> Iterator[tuple]:
        (w, h), n = b.size, self.size
        for row in b.rows:
            for col in _within(self.cols, ceil(w / n)):
                x, y = col * n, row * n
                try:
                    region = reader.region(b.path, b.depth, x, y, min(n, w - x), min(n, h - y), *b.offset)
                    edge = edge_value(region, n)
                    if self.above is not None and edge <= self.above:
                        continue
                    made = (resized(region, n, n).tobytes(), edge, None)
                except ImportError:
                    raise
                except Exception as e:
                    made = (None, None, f"{type(e).__name__}: {e}")
                yield b.path, b.depth, col, row, *made


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileSource)
