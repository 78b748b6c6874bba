"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are split into pre-tokens with their positions. Each block of documents (a part of an input
partition) keeps its own list of distinct pre-tokens, numbered as they first appear, and its texts
as lists of those numbers in order of position. Only the distinct pre-tokens are shuffled by word:
equal words of all blocks meet, each distinct word is merged once, and the ids are joined back by
block and number and put in order of position. The block lists are made twice from the same rows
(once for the words, once for the positions) instead of being stored, which saves the disk for
them; a block is named by a hash of its words, and a word without ids stops the job, so input
that doesn't read alike twice can't give wrong ids. Decoding joins the table of token bytes, whose
size the vocabulary fixes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from hashlib import md5
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import released, trim

#: Characters of the documents that share one list of distinct words.
BLOCK_CHARS = 14 << 20
#: Pre-tokens in a row of positions.
PART_WORDS = 1 << 18
#: Encoded words that are put together by block before they go back to it.
PACK_WORDS = 1 << 18
#: Longer words are merged by a heap instead of scans.
SCAN_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SCAN_BYTES:
        return _heap_merged(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < 1 << 60:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at i and ends at end[i]; 0: merged away
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not (j := end[i]) or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := get(word[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _latin(pattern: str) -> str | None:
    """The pattern with its Unicode classes spelt out for characters up to U+00FF, or None if it has others."""

    def members(one: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(one, chr(c)))

    known = {one: members(one) for one in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for m in re.finditer(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        x = m[0]
        if x in known:
            x = known[x] if inside else f"[{known[x]}]"
        elif x == r"\S" and not inside:
            x = f"[^{known[r'\s']}]"
        elif x[0] == "\\" and x[1].isalnum():
            return None
        inside = x == "[" or inside and x != "]"
        out.append(x)
    return "".join(out)


def finder(pattern: str):
    """All matches of the pattern in a text. Texts of Latin-1 characters take the faster of two engines with the same result."""
    slow, latin = regex.compile(pattern).findall, _latin(pattern)
    if latin is None:
        return slow
    fast = re.compile(latin).findall

    def find(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return slow(text)
        return fast(text)

    return find


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, bool]]:
    """(doc_id, text, whether a block of documents ends here); the last block may end with the partition."""
    size = 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py() or ""
            size += len(text)
            yield doc_id, text, size >= BLOCK_CHARS
            if size >= BLOCK_CHARS:
                size = 0


def _name(words) -> int:
    """A block is known by its words, in order of first appearance."""
    return int.from_bytes(md5("\0".join(words).encode()).digest()[:8], "little", signed=True)


def _word_rows(pattern: str):
    def rows(seen: dict[str, None]) -> Iterator[pa.RecordBatch]:
        words, name = list(seen), _name(seen)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(i, i + len(part)), pa.int32()), pa.array(part)], ["block", "number", "word"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = finder(pattern), {}
        for _, text, last in _texts(batches):
            seen.update(dict.fromkeys(find(text)))
            if last:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    return run


def _planes(x: np.ndarray) -> bytes:
    """int32 to compressed byte planes: the upper ones are nearly empty."""
    return zstandard.compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view("<i4").ravel()


class _Places:
    """The texts of a block as numbers of its words, in parts of about PART_WORDS."""

    def __init__(self) -> None:
        self.words, self.parts = _Numbers(), []
        self.ids, self.counts, self.numbers = [], [], array("i")

    def add(self, doc_id: int | None, found: list[str]) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(found))
        self.numbers.extend(map(self.words.__getitem__, found))
        if len(self.numbers) >= PART_WORDS:
            self.cut()

    def cut(self) -> None:
        if self.ids:
            self.parts.append((self.ids, self.counts, _planes(np.frombuffer(self.numbers, np.int32))))
            self.ids, self.counts, self.numbers = [], [], array("i")

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        name = _name(self.words)
        for ids, counts, blob in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([blob], pa.binary())], ["block", "ids", "counts", "numbers"])


def _position_rows(pattern: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, places = finder(pattern), _Places()
        for doc_id, text, last in _texts(batches):
            places.add(doc_id, find(text))
            if last:
                yield from places.rows()
                places = _Places()
        yield from places.rows()

    return run


def _encode_rows(ranks, width: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, ids, held, n = ranks.value, None, b"", ([], [], []), 0
        for b in batches:
            held[0].append(b.column(0).to_numpy())
            held[1].append(b.column(1).to_numpy())
            for word in b.column(2).to_pylist():
                if word != last:  # rows are sorted by word
                    last, ids = word, np.array(merged(word.encode(), table), width).tobytes()
                held[2].append(ids)
            n += b.num_rows
            if n >= PACK_WORDS:
                yield _packed(*held)
                held, n = ([], [], []), 0
        if n:
            yield _packed(*held)

    return run


def _packed(blocks: list[np.ndarray], numbers: list[np.ndarray], ids: list[bytes]) -> pa.RecordBatch:
    """A row for each block: steps between its word numbers, bytes of ids of each, and the ids."""
    block, number = np.concatenate(blocks), np.concatenate(numbers)
    order = np.lexsort((number, block))
    block, number = block[order], number[order]
    sizes = np.fromiter(map(len, ids), np.int32, len(ids))[order]
    ends = np.flatnonzero(np.r_[block[1:] != block[:-1], True]) + 1
    rows = [(block[a], _planes(np.diff(number[a:e], prepend=0)), _planes(sizes[a:e]), b"".join([ids[i] for i in order[a:e]])) for a, e in zip(np.r_[0, ends[:-1]], ends)]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["block", "steps", "sizes", "ids"])


def _placed(width: str):
    def run(words, rows):
        """Token ids of each text of a block, in order of position."""
        trim()
        parts = [(np.cumsum(_unplanes(s.as_py())), _unplanes(z.as_py()), i.as_py()) for s, z, i in zip(words["steps"], words["sizes"], words["ids"])]
        number = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.int64)
        lens = np.concatenate([x[1] for x in parts]).astype(np.int64) // np.dtype(width).itemsize if parts else number
        flat = np.frombuffer(b"".join(x[2] for x in parts), width)
        n = int(number.max()) + 1 if len(number) else 0
        size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size[number], start[number] = lens, np.cumsum(lens) - lens
        out = []
        for ids, counts, numbers in zip(rows["ids"], rows["counts"], rows["numbers"]):
            x = _unplanes(numbers.as_py())
            if len(x) and (int(x.max()) >= n or not size[x].all()):
                raise ValueError("a block's words changed between two reads: encode a stored table")
            m = size[x]
            last = np.cumsum(m)
            tokens = flat[np.repeat(start[x] - (last - m), m) + np.arange(last[-1] if len(last) else 0)].astype(np.int32)
            offsets = np.r_[0, last][np.r_[0, np.cumsum(counts.values.to_numpy())]].astype(np.int32)
            out.append(pa.RecordBatch.from_arrays([ids.values, pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], ["doc_id", "ids"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, ids array<int>), a row for each row of docs.

    Each match of the pattern is encoded by itself; text between matches, if any, has no ids. A
    null text counts as empty and has no ids. Repeated rows give repeated rows, an empty table
    none; other columns are not read.
    """
    table = read_ranks(ranks_path)
    ranks = docs.sparkSession.sparkContext.broadcast(table)  # as large as the vocabulary
    width = "<u2" if max(table.values()) < 1 << 16 else "<i4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = rows.mapInArrow(_word_rows(pattern), "block long, number int, word string")
    words = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_rows(ranks, width), "block long, steps binary, sizes binary, ids binary")
    places = rows.mapInArrow(_position_rows(pattern), "block long, ids array<long>, counts array<int>, numbers binary")
    return words.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_placed(width), "doc_id long, ids array<int>")


def _bytes_of(ids: np.ndarray, known: list[bytes | None]) -> bytes:
    if len(ids) and (ids.min() < 0 or ids.max() >= len(known)):
        raise IndexError("a token id that the vocabulary doesn't have")
    try:
        return b"".join(map(known.__getitem__, ids.tolist()))
    except TypeError:
        raise IndexError("a token id in a gap of the vocabulary's ranks") from None


def decoded(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """tokens and bytes binary: the token bytes of ids in a row, whatever they encode. Null ids give null.

    An id outside the vocabulary (a negative one, or one of a gap in the ranks) stops the job. The token-byte table goes to
    the tasks whole, as the vocabulary bounds it, and is joined to the ids there, so that no token is a row of a shuffle.
    """
    ranks = read_ranks(ranks_path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = tokens.sparkSession.sparkContext.broadcast(table)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            at = b.schema.get_field_index("ids")
            made = [_bytes_of(v.values.to_numpy(), known) if v.is_valid else None for v in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, "bytes"])

    tokens = tokens.drop("bytes")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{kinds}, bytes binary")
