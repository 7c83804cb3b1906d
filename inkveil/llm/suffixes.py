"""Suffix order around cover samples, one bucket at a time (operator 1).

The suffixes to be told apart are the windows that pass the cover of ``repeats``.  Each has
one anchor: the leftmost smallest k-gram in it.  Equal windows have the same anchor at the
same distance, so anchors are a difference cover chosen by content: what is a sample in one
place is a sample in every place with the same text, and any two suffixes to be compared
reach samples at a common distance.  (A cover by position modulo v promises that for only
one of some 17 samples in 273 positions, and would have to hold six times as many.)

Each chunk sends each different neighbourhood, the text around an anchor, once; equal ones
are counted before they meet others of their anchor.  Buckets are runs of anchors that come
sorted and hold up to ``HELD`` bytes.  In a bucket

1. the anchors are ranked by the text that follows them (the sample suffixes' order), with
   the longest common prefixes of neighbours in that order, and likewise by the text before
   them, read backwards;
2. a window that begins ``o`` units before its anchor equals another iff both agree on o
   units before it and width - o from it on.  So ties are resolved by two ranks, whatever
   their length: the window's suffix class is the pair of rank groups at these depths.

An anchor whose different neighbourhoods alone pass that size is not held: its windows go on
one by one and are counted by their text, spread over all tasks.  Comparisons are of text,
not of fingerprints; fingerprints only choose bucket and anchor.  Memory is bounded by the
bucket: its neighbourhoods, one table of their bytes, and for one distance o at a time the
pairs of ranks.  What goes back to a chunk is the windows that nothing else has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .repeats import CHUNK, Chunk, Segment, Store, Sums, Unit, by_row, scramble, sliding_min

#: Bytes of neighbourhoods that a bucket holds at most.
HELD = 16 << 20

_SENT = pa.schema([("anchor", pa.int64()), ("before", pa.int32()), ("text", pa.binary()), ("copies", pa.int64()), ("chunk", pa.int64()), ("at", pa.int32())])
_SENT_DDL = "anchor long, before int, text binary, copies long, chunk long, at int"
# Windows of a chunk's neighbourhood that are alone; or a window still to be counted, with its text.
_JUDGED = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("alone", pa.binary()), ("text", pa.binary()), ("copies", pa.int64())])
_JUDGED_DDL = "chunk long, at int, alone binary, text binary, copies long"


def anchored(seg: Segment, at: np.ndarray, unit: Unit) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, anchor position, anchor fingerprint) of neighbouring passing windows with one anchor."""
    grams = Sums(seg.codes).of(unit.gram)
    choices = unit.width - unit.gram + 1
    least = sliding_min(grams, choices)[at]
    piece = np.searchsorted(seg.start, at, side="right")
    cut = np.flatnonzero((np.diff(at) != 1) | (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    # Smallest fingerprints are all small; scrambled again, they spread over the buckets.
    spread = scramble(least[begin]).tolist()
    for p0, p1, value, anchor in zip(at[begin].tolist(), at[end].tolist(), least[begin], spread):
        places = np.flatnonzero(grams[p0 : p1 + choices] == value) + p0
        first = p0
        for q in places.tolist():
            last = min(q, p1)
            if last >= first:
                yield first, last, q, anchor
                first = last + 1
            if first > p1:
                break


class Neighbourhoods:
    """What a chunk sends: each different text around an anchor once, and where it has it."""

    def __init__(self, chunk: Chunk, bits):
        unit, known = chunk.unit, {}
        self.row, self.start, self.which = [], [], []
        for seg, at in chunk.passing(bits):
            first_of, begins = seg.first, seg.start
            for first, last, q, value in anchored(seg, at, unit):
                piece = int(np.searchsorted(begins, first, side="right")) - 1
                doc, shift = int(seg.doc[piece]), int(first_of[piece] - begins[piece])
                text = chunk.texts[doc][first + shift : last + shift + unit.width]
                self.row.append(doc)
                self.start.append(first + shift)
                self.which.append(known.setdefault((value, q - first, text), len(known)))
        self.known = list(known)
        self.which = np.array(self.which, np.int64)
        self.size = np.array([len(t) - unit.width + 1 for _, _, t in known], np.int64)  # windows
        self.copies = np.bincount(self.which, minlength=len(known))

    def send(self, number: int, rows: int = 2000) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.known), rows):
            part = self.known[at : at + rows]
            n = len(part)
            columns = [
                np.array([k[0] for k in part], np.uint64).view(np.int64), np.array([k[1] for k in part], np.int32), [k[2] for k in part],
                self.copies[at : at + n], np.full(n, number), np.arange(at, at + n),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SENT)], schema=_SENT)

    def hits(self, alone) -> tuple[np.ndarray, np.ndarray]:
        """Row and start of each window but those that came back as alone."""
        end = np.cumsum(self.size)
        begin = end - self.size
        hit = np.ones(int(self.size.sum()), bool)
        for r in alone or ():
            hit[begin[r["at"]] + np.frombuffer(r["alone"], np.int32)] = False
        row, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, first, w in zip(self.row, self.start, self.which.tolist()):
            at = np.flatnonzero(hit[begin[w] : end[w]])
            if len(at):
                row.append(np.full(len(at), doc))
                start.append(at + first)
        return np.concatenate(row), np.concatenate(start)


def _ranked(anchor: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of texts within their anchors, and what each has in common with the one before it (-1: another anchor)."""
    n = len(texts)
    keys = [a.to_bytes(8, "big") + t for a, t in zip(anchor.tolist(), texts)]
    order = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    common = np.full(n, -1, np.int64)
    if n < 2:
        return order, common
    width = int(size.max()) + 1
    for at in range(1, n, 4096):
        # Some thousand at a time, as rows of a table; the last column differs for all.
        own = order[at - 1 : at + 4096]
        flat = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
        differ = flat[1:] != flat[:-1]
        differ[:, -1] = True
        upto = np.minimum(differ.argmax(axis=1), np.minimum(size[own[1:]], size[own[:-1]]))
        common[at : at + 4096] = np.where(anchor[own[1:]] == anchor[own[:-1]], upto, -1)
    return order, common


def _groups(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Of each text the number of its group: those that agree on ``depth`` units."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_windows(anchor: np.ndarray, before: np.ndarray, text: list[bytes], width: int) -> list[np.ndarray]:
    """For each neighbourhood, which of its windows another one has too."""
    size = np.array([len(t) - width + 1 for t in text], np.int64)
    after, since = _ranked(anchor, [t[b:] for t, b in zip(text, before.tolist())])
    back, until = _ranked(anchor, [t[:b][::-1] for t, b in zip(text, before.tolist())])
    least = before - size + 1  # the last window's distance to the anchor
    base = np.cumsum(size) - size
    hit = np.zeros(int(size.sum()), bool)
    for o in range(int(least.min()) if len(least) else 0, int(before.max(initial=-1)) + 1):
        own = np.flatnonzero((least <= o) & (before >= o))
        if len(own) < 2:
            continue
        pair = _groups(after, since, width - o)[own] * (len(text) + 1) + _groups(back, until, o)[own]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        both = np.zeros(len(own), bool)
        both[by[1:][same]] = True
        both[by[:-1][same]] = True
        hit[base[own] + before[own] - o] = both
    return np.split(hit, base[1:])


def merged(sent: DataFrame, width: int) -> DataFrame:
    """chunk, alone: array of (at, alone), the windows of its neighbourhoods that nothing else has."""
    held = HELD

    def judged(rows: list[dict]) -> pa.RecordBatch:
        anchor = np.array([r["anchor"] for r in rows], np.int64)
        before = np.array([r["before"] for r in rows], np.int64)
        hits = repeated_windows(anchor.view(np.uint64), before, [r["text"] for r in rows], width)
        # A neighbourhood that is there twice has no window that is alone.
        out = [(r["chunk"], r["at"], np.flatnonzero(~h).astype(np.int32).tobytes()) for r, h in zip(rows, hits) if r["copies"] == 1 and not h.all()]
        columns = [[x[i] for x in out] for i in range(3)] + [[None] * len(out)] * 2
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _JUDGED)], schema=_JUDGED)

    def apart(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            n, text = len(r["text"]) - width + 1, r["text"]
            place = [i.to_bytes(4, "little") for i in range(n)]
            columns = [[r["chunk"]] * n, [r["at"]] * n, place, [text[i : i + width] for i in range(n)], [r["copies"]] * n]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _JUDGED)], schema=_JUDGED)

    def run(batches):
        done, now, size, own, crowded, last = [], [], 0, 0, False, None
        # done: rows of whole anchors; now: those of the anchor at hand, of own bytes.
        for b in batches:
            for r in b.to_pylist():
                if r["anchor"] != last:
                    if not crowded:
                        done += now
                        size += own
                        if size > held:
                            yield judged(done)
                            done, size = [], 0
                    now, own, crowded, last = [], 0, False, r["anchor"]
                if crowded:
                    yield from apart([r])
                    continue
                now.append(r)
                own += len(r["text"])
                if own > held:
                    yield from apart(now)
                    now, own, crowded = [], 0, True
        if done or now:
            yield judged(done + now)

    counted = sent.groupBy("anchor", "before", "text").agg(F.sum("copies").alias("copies"), F.min("chunk").alias("chunk"), F.min("at").alias("at"))
    ordered = counted.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "before", "text", "copies", "chunk", "at")
    found = staged(ordered.mapInArrow(run, _JUDGED_DDL), "judged")
    # Windows of crowded anchors: one row each, by their text.  Only those of one copy matter, so the least place is theirs.
    single = found.where("text is not null").groupBy("text").agg(F.sum("copies").alias("copies"), *[F.min(x).alias(x) for x in ("chunk", "at", "alone")]).where("copies = 1")
    back = found.where("text is null").select("chunk", "at", "alone").unionByName(single.select("chunk", "at", "alone"))
    return back.groupBy("chunk").agg(F.collect_list(F.struct("at", "alone")).alias("alone"))


def repeats(docs: DataFrame, unit: Unit, finish: Callable, schema: str, chunk: int = CHUNK) -> DataFrame:
    """finish(rows, texts, marks) -> record batch, for each chunk: marks[i] are the starts of
    document i's windows that start anywhere else too."""
    store = Store(docs, unit, False, chunk)

    def gather(batches):
        for b in batches:
            for number, data, bits in zip(b.column("chunk").to_pylist(), b.column("rows"), b.column("samples").to_pylist()):
                yield from Neighbourhoods(Chunk(data.as_py(), unit, False), bits).send(number)

    def judge(batches):
        for b in batches:
            for data, samples, alone in zip(b.column("rows"), b.column("samples").to_pylist(), b.column("alone").to_pylist()):
                c = Chunk(data.as_py(), unit, False)
                row, start = Neighbourhoods(c, samples).hits(alone)
                yield finish(c.rows, c.texts, by_row(row, start, len(c.texts)))

    return store.answered(merged(store.joined.mapInArrow(gather, _SENT_DDL), unit.width), "alone").mapInArrow(judge, schema)
