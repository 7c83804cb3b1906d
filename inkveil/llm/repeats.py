"""Repeated windows of a corpus: what the two substring dedup operators (1, 4) share.

A window is ``width`` consecutive units (bytes or words) of one document.  The corpus is cut
into chunks: some megabytes of whole documents, one compressed row each, in a table of the
shared folder that is bucketed by chunk, so that later joins by chunk move no text.

The first pass finds which windows can be repeated at all.  Of every ``span`` units the k-gram
with the smallest fingerprint is a sample.  Two equal windows hold the same samples at the
same distances, wherever they begin, so the samples are a cover chosen by content.  Each chunk
sends the set of its samples' fingerprints, in sorted runs cut at the bounds of fingerprint
buckets; one bucket at a time is merged, and a bit for each comes back: is it also another
chunk's?  A window can only be repeated if all of its samples are.  Fingerprints decide no
more than that: which windows are equal is found on their text (``suffixes``, ``trees``).

A fingerprint is a polynomial in 64 bits over random unit codes, scrambled; a chunk sends it
once however often it has it, so a passage that a third of all documents hold is one entry a
chunk.  Buckets hold as much as the shuffle partitions are sized for, divided by ``SPLIT``.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import pieces_of, shared_path, small_batches

CHUNK, SEGMENT, SPLIT = 4 << 20, 1 << 18, 4
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Unit:
    """What windows are made of: ``codes(text bytes)`` gives a random 64-bit code for each unit.
    ``many`` gives those of a list of texts, where that is faster than one by one."""

    codes: Callable[[bytes], np.ndarray]
    width: int
    gram: int
    span: int
    many: Callable[[list[bytes]], list[np.ndarray]] | None = None


# --- fingerprints -----------------------------------------------------------------------


class Powers:
    """Powers of BASE and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(size, np.uint64(base))
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_powers = Powers()


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sums:
    """Running polynomial sums of unit codes, for the fingerprint of any stretch."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = _powers.to(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up[:n], out=self.sums[1:])

    def of(self, width: int, at: np.ndarray | None = None) -> np.ndarray:
        if at is None:
            n = max(0, len(self.sums) - width)
            return scramble((self.sums[width:] - self.sums[:n]) * self.down[:n])
        return scramble((self.sums[at + width] - self.sums[at]) * self.down[at])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, by running minima from both sides of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    whole = -(-len(x) // w) * w
    y = np.full(whole, np.iinfo(x.dtype).max, x.dtype)
    y[: len(x)] = x
    y = y.reshape(-1, w)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


# --- chunks -----------------------------------------------------------------------------


def pack_rows(rows: pa.Table | pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write(rows)
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, rows: documents as compressed Arrow rows, bucketed by chunk in the shared folder.

    A chunk's number is fixed when its row is written, so every pass sees the same chunks.
    """
    out = pa.schema([("chunk", pa.int64()), ("rows", pa.binary())])

    def emit(parts, number):
        rows = pa.Table.from_batches(parts).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack_rows(rows)], pa.binary())], schema=out)

    def run(batches):
        task, made, parts, total = TaskContext.get().partitionId(), 0, [], 0
        for b in pieces_of(batches, size=size // 4):
            parts.append(b)
            total += b.nbytes
            if total >= size:
                yield emit(parts, (task << 32) | made)
                made, parts, total = made + 1, [], 0
        if parts:
            yield emit(parts, (task << 32) | made)

    spark = docs.sparkSession
    small_batches(spark)
    name = f"inkveil_chunks_{uuid.uuid4().hex}"
    writer = docs.mapInArrow(run, "chunk long, rows binary").write.bucketBy(partitions(spark), "chunk")
    try:
        writer.option("path", shared_path(spark, "chunks")).option("compression", "uncompressed").saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # only its name: the files are the shared folder's, and the table's plan knows them


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Segment:
    """Up to SEGMENT units and what lies after them, of whole documents or a piece of a long one."""

    codes: np.ndarray
    doc: np.ndarray  # row of the chunk, for each piece
    start: np.ndarray  # of each piece, in codes
    first: np.ndarray  # of each piece, in its document
    windows: np.ndarray  # that begin in each piece


def segments(units: list[np.ndarray], width: int) -> Iterator[Segment]:
    """Documents, in pieces that overlap by width - 1 units, gathered to about SEGMENT units."""
    held, size = [], 0

    def gathered():
        lengths = [len(c) for _, _, c, _ in held]
        return Segment(
            np.concatenate([c for _, _, c, _ in held]), np.array([d for d, _, _, _ in held]), np.cumsum([0, *lengths[:-1]]),
            np.array([f for _, f, _, _ in held]), np.array([w for _, _, _, w in held]),
        )

    for d, codes in enumerate(units):
        total = len(codes) - width + 1
        for at in range(0, total, SEGMENT):
            n = min(SEGMENT, total - at)
            piece = codes[at : at + n + width - 1]
            if size and size + len(piece) > SEGMENT:
                yield gathered()
                held, size = [], 0
            held.append((d, at, piece, n))
            size += len(piece)
    if held:
        yield gathered()


def _inside(seg: Segment, width: int, n: int) -> np.ndarray:
    """Which of n starts leave room for width units in their piece."""
    ends = np.append(seg.start[1:], len(seg.codes))
    delta = np.zeros(len(seg.codes) + 1, np.int8)
    room = np.maximum(ends - seg.start - width + 1, 0)
    np.add.at(delta, seg.start, (room > 0).astype(np.int8))
    np.add.at(delta, seg.start + room, -(room > 0).astype(np.int8))
    return np.cumsum(delta)[:n] > 0


class Cover:
    """The samples of a segment: for each stretch of ``span`` units its smallest k-gram, as runs."""

    def __init__(self, seg: Segment, unit: Unit):
        grams = Sums(seg.codes).of(unit.gram)
        choices = unit.span - unit.gram + 1
        least = sliding_min(grams, choices)
        n = len(least)
        inside = _inside(seg, unit.span, n)
        edge = np.ones(n, bool)
        edge[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        edge[seg.start[seg.start < n]] = True
        self.begin = np.flatnonzero(edge)
        self.length = np.diff(np.append(self.begin, n))
        keep = inside[self.begin]
        self.begin, self.length = self.begin[keep], self.length[keep]
        # Smallest fingerprints are all small; scrambled again, they spread over the buckets.
        self.value = scramble(least[self.begin])
        # One place is the smallest of at most ``choices`` stretches; a longer run has two.
        self.twice = self.length > choices
        self.doc = seg.doc[np.searchsorted(seg.start, self.begin, side="right") - 1]
        self.n = n

    def candidates(self, unit: Unit, seg: Segment, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows all of whose samples (runs) are repeated."""
        bad = np.zeros(self.n + 1, np.int64)
        for b, d in ((self.begin, 1), (self.begin + self.length, -1)):
            np.add.at(bad, b, d * ~repeated)
        wrong = np.cumsum(np.cumsum(bad)[: self.n] > 0)
        wrong = np.concatenate([[0], wrong])
        stretch = unit.width - unit.span + 1
        at = np.flatnonzero(_inside(seg, unit.width, max(0, self.n - stretch + 1)))
        return at[wrong[at + stretch] == wrong[at]]


# --- runs of fingerprints, cut into buckets ---------------------------------------------

_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])
_SENT_DDL = "part int, chunk long, n long, keys binary"
_BACK = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])
_BACK_DDL = "chunk long, part int, n long, bits binary"


def bounds(parts: int) -> np.ndarray:
    """The first fingerprint of each bucket."""
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers: small numbers leave planes of zeros, which compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes, n: int, dtype=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).reshape(-1).view(dtype)


def send(chunk: int, keys: np.ndarray, parts: int):
    """A row for each bucket that the sorted keys reach into."""
    first = bounds(parts)
    cut = np.append(np.searchsorted(keys, first), len(keys))
    rows = {n: [] for n in _SENT.names}
    for part in np.flatnonzero(np.diff(cut)):
        a, b = cut[part], cut[part + 1]
        rows["part"].append(int(part))
        rows["chunk"].append(chunk)
        rows["n"].append(int(b - a))
        rows["keys"].append(planes(np.diff(keys[a:b], prepend=first[part])))
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _SENT], schema=_SENT)


def merged(sent: DataFrame, parts: int) -> DataFrame:
    """One bucket at a time: a bit for each entry, whether the key is also another chunk's."""

    def run(key, table):
        first = bounds(parts)[key[0].as_py()]
        sizes = table.column("n").to_numpy()
        runs = [np.cumsum(unplanes(k.as_py(), n)) + first for k, n in zip(table.column("keys"), sizes.tolist())]
        keys = np.concatenate(runs)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        hit = np.zeros(len(keys), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        cuts = np.cumsum(sizes)[:-1]
        bits = [np.packbits(h).tobytes() for h in np.split(hit, cuts)]
        arrays = [table.column("chunk").combine_chunks(), table.column("part").combine_chunks(), table.column("n").combine_chunks(), pa.array(bits, pa.binary())]
        return pa.Table.from_arrays(arrays, schema=_BACK)

    return sent.groupBy("part").applyInArrow(run, _BACK_DDL)


def returned(back: DataFrame, label: str) -> DataFrame:
    """chunk, and the bits of all its buckets in order."""
    rows = F.sort_array(F.collect_list(F.struct("part", "n", "bits")))
    return back.groupBy("chunk").agg(rows.alias(label))


def told(found) -> np.ndarray:
    """The bits of a chunk, in the order of its sorted keys."""
    if not found:
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in found])


# --- chunks in the passes -------------------------------------------------------------------


class Chunk:
    """A chunk's rows, its samples (sorted, and whether it holds each twice itself: in two
    documents, if ids count), and the windows that pass once the samples' bits are back."""

    def __init__(self, data: bytes, unit: Unit, ordered: bool):
        self.rows = unpack_rows(data)
        self.unit = unit
        self.texts = [(t or "").encode() for t in self.rows.column("text").to_pylist()]
        self.ids = self.rows.column("doc_id").fill_null(NO_ID).to_numpy() if ordered else None
        # Documents without a whole window are passed over, so segments hold little else.
        codes = unit.many(self.texts) if unit.many else list(map(unit.codes, self.texts))
        self.parts = [(seg, Cover(seg, unit)) for seg in segments(codes, unit.width)]
        value, twice, doc = (np.concatenate([getattr(c, n) for _, c in self.parts]) if self.parts else np.zeros(0, t) for n, t in (("value", np.uint64), ("twice", bool), ("doc", np.int64)))
        order = np.argsort(value, kind="stable")
        value, twice, doc = value[order], twice[order], doc[order]
        begin = np.flatnonzero(np.diff(value, prepend=~value[:1])) if len(value) else np.zeros(0, np.int64)
        self.keys = value[begin]
        if not len(begin):
            self.often = np.zeros(0, bool)
        elif self.ids is None:
            self.often = (np.diff(np.append(begin, len(value))) > 1) | np.maximum.reduceat(twice, begin)
        else:
            own = self.ids[doc]
            self.often = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)

    def passing(self, bits) -> Iterator[tuple[Segment, np.ndarray]]:
        """Segments with starts of windows all of whose samples are repeated."""
        repeated = self.often | told(bits)
        for seg, cover in self.parts:
            if len(cover.value):
                at = cover.candidates(self.unit, seg, repeated[np.searchsorted(self.keys, cover.value)])
                if len(at):
                    yield seg, at


class Store:
    """The chunks of a corpus and, joined to them, the bits of their samples (pass 1)."""

    def __init__(self, docs: DataFrame, unit: Unit, ordered: bool, size: int = CHUNK):
        spark = docs.sparkSession
        self.table, self.parts, parts = chunked(docs, size), SPLIT * partitions(spark), SPLIT * partitions(spark)

        def sample(batches):
            for b in batches:
                for number, data in zip(b.column("chunk").to_pylist(), b.column("rows")):
                    yield send(number, Chunk(data.as_py(), unit, ordered).keys, parts)

        # The bits go back to the chunks twice, so they are kept.
        samples = returned(merged(self.table.mapInArrow(sample, _SENT_DDL), parts), "samples")
        path = shared_path(spark, "samples")
        samples.write.option("compression", "zstd").parquet(path)
        self.samples = spark.read.schema(samples.schema).parquet(path)
        self.joined = self.table.join(self.samples.hint("shuffle_hash"), "chunk", "left")

    def answered(self, back: DataFrame, label: str) -> DataFrame:
        """rows, samples and what came back (chunk, label) for each chunk."""
        both = self.samples.join(back, "chunk", "left")
        return self.table.join(both.hint("shuffle_hash"), "chunk", "left").select("rows", "samples", label)


def by_row(row: np.ndarray, start: np.ndarray, n: int) -> list[np.ndarray]:
    """The starts of each of n rows, ascending."""
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    cut = np.searchsorted(row, np.arange(n + 1))
    return [start[cut[i] : cut[i + 1]] for i in range(n)]


def covered(marks: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n units lie in a window that begins at a mark."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, marks, 1)
    np.add.at(delta, marks + width, -1)
    return np.cumsum(delta)[:n] > 0
