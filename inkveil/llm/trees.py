"""Prefix-partitioned suffix trees over words (operator 4).

The windows to be told apart are those of ``width`` words that pass the cover of ``repeats``.
Each has one anchor, its leftmost smallest k-gram of words, so equal windows have equal anchors
at equal places, and the suffixes that are sorted into trees are those that begin at anchors: a
sparse suffix tree, whose nodes at the depth of a k-gram are the anchors.  Suffixes go to groups
by variable-length prefixes: a group is the range of texts from one prefix to the next, and
prefixes are as long as it takes to tell the groups' bounds apart.  The bounds come from a
bounded sample of windows and only set how even the groups are: equal texts are always in one
group, whatever the bounds.  All is text, the words joined by a space; nothing here rests on a
fingerprint.

A group's suffixes stream by in order of their anchors, one anchor's subtree at a time.  Its
leaves are the suffixes that begin at windows, sorted; what neighbours have in common gives its
inner nodes, from a stack.  A node of ``width`` words or more under one of less is where all
leaves below begin with one window; with leaves in two documents it is a repeat, and its
smallest document keeps it.  Neighbouring repeats of a document make the maximal ones.  An anchor
whose subtree passes ``HELD`` bytes is not held: its windows go on one by one, their smallest
documents are found by aggregation, and they meet these in a join that Spark can split.  So a
passage that a third of all documents hold is never a group in memory.

A chunk sends each different neighbourhood of an anchor once, with the smallest document that
has it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .repeats import CHUNK, NO_ID, Chunk, Segment, Store, Sums, Unit, by_row, sliding_min, unpack_rows

#: Chunks that are sampled, about, and windows of each, to choose the groups' bounds.
SAMPLED, EACH = 24, 400
#: Leaves whose answers are packed together, and bytes of one anchor's subtree in memory.
PACK, HELD = 1 << 18, 4 << 20

_SENT = pa.schema([("part", pa.int32()), ("anchor", pa.binary()), ("before", pa.int32()), ("text", pa.binary()), ("doc", pa.int64()), ("chunk", pa.int64()), ("at", pa.int32())])
_SENT_DDL = "part int, anchor binary, before int, text binary, doc long, chunk long, at int"
# Windows of a chunk (their places among those of its neighbourhoods) that a smaller document has; or one that is still to be sorted in.
_JUDGED = pa.schema([("chunk", pa.int64()), ("found", pa.binary()), ("suffix", pa.binary()), ("doc", pa.int64()), ("at", pa.int32())])
_JUDGED_DDL = "chunk long, found binary, suffix binary, doc long, at int"
_FOUND = pa.schema([("chunk", pa.int64()), ("found", pa.binary())])


def prefixes(sample: list[bytes], groups: int) -> list[bytes]:
    """Ascending lower bounds of groups 1, 2, ...: the shortest prefixes that part evenly spaced samples from those before them."""
    sample, out = sorted(set(sample)), []
    for i in range(1, groups):
        at = i * len(sample) // groups
        if at:
            before, own = sample[at - 1], sample[at]
            n = next((j for j, (a, b) in enumerate(zip(before, own)) if a != b), len(before)) + 1
            if not out or own[:n] > out[-1]:
                out.append(own[:n])
    return out


def bounds(store: Store, width: int) -> list[bytes]:
    """The bounds of the groups, from some windows of about SAMPLED chunks."""
    chunks = store.samples.count()
    every = max(1, chunks // SAMPLED)

    def some(batches):
        for b in batches:
            for data in b.column("rows"):
                texts = [(t or "").encode() for t in unpack_rows(data.as_py()).column("text").to_pylist()]
                windows = np.array([max(0, len(t.split()) - width + 1) for t in texts], np.int64)
                last = np.cumsum(windows)
                if not windows.sum():
                    continue
                spread = np.linspace(0, last[-1] - 1, min(EACH, int(last[-1]))).astype(np.int64)
                out = []
                for i, at in zip(np.searchsorted(last, spread, side="right").tolist(), spread.tolist()):
                    out.append(b" ".join(texts[i].split()[at - int(last[i] - windows[i]) :][:4])[:48])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["prefix"])

    picked = store.table.where(F.pmod(F.xxhash64("chunk"), F.lit(every)) == 0)
    rows = picked.mapInArrow(some, "prefix binary").limit(4 * SAMPLED * EACH).collect()
    return prefixes([bytes(r["prefix"]) for r in rows], store.parts)


def anchored(seg: Segment, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(piece, first window, number of windows, distance to the anchor) of neighbouring passing windows with one anchor.

    As ``suffixes.anchored``, for windows of few k-grams: all windows step to their leftmost smallest one together.
    """
    grams = Sums(seg.codes).of(unit.gram)
    choices = unit.width - unit.gram + 1
    least = sliding_min(grams, choices)[at]
    anchor = at.copy()
    for step in range(choices - 1, -1, -1):
        here = grams[at + step] == least
        anchor[here] = at[here] + step
    piece = np.searchsorted(seg.start, at, side="right") - 1
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0) | (np.diff(piece) != 0)]))
    return piece[begin], at[begin], np.diff(begin, append=len(at)), (anchor - at)[begin]


class Neighbourhoods:
    """The different texts around anchors of a chunk's windows that pass, their smallest
    documents, and where the chunk has them.  ``at`` is the place of a text's first window."""

    def __init__(self, chunk: Chunk, samples):
        unit, known, which, runs = chunk.unit, {}, [], [[np.zeros(0, np.int64)] * 3]
        for seg, at in chunk.passing(samples):
            piece, first, n, before = anchored(seg, at, unit)
            doc, start = seg.doc[piece], first - seg.start[piece] + seg.first[piece]
            runs.append((doc, start, n))
            # One document at a time; its words are joined by single spaces.
            cut = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
            for i, j in zip(cut.tolist(), cut[1:].tolist()):
                whole = b" ".join(chunk.texts[doc[i]].split())
                place = np.concatenate([[0], np.flatnonzero(np.frombuffer(whole, np.uint8) == 32) + 1, [len(whole) + 1]])
                begin, end = place[start[i:j]], place[start[i:j] + n[i:j] - 1 + unit.width] - 1
                for b, x, y in zip(before[i:j].tolist(), begin.tolist(), end.tolist()):
                    which.append(known.setdefault((b, whole[x:y]), len(known)))
        self.row, self.start, n = map(np.concatenate, zip(*runs))
        self.known, self.gram, self.own, self.which = list(known), unit.gram, chunk.ids, np.array(which, np.int64)
        self.least = np.full(len(known), NO_ID)
        np.minimum.at(self.least, self.which, self.own[self.row])
        self.size = np.zeros(len(known), np.int64)
        self.size[self.which] = n
        self.at = np.cumsum(self.size) - self.size

    def send(self, number: int, first: list[bytes], rows: int = 5000) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.known), rows):
            part = self.known[i : i + rows]
            anchors = [b" ".join(text.split(b" ", b + self.gram)[b : b + self.gram]) for b, text in part]
            n = len(part)
            columns = [
                [bisect_right(first, x) for x in anchors], anchors, [b for b, _ in part], [text for _, text in part],
                self.least[i : i + n], np.full(n, number), self.at[i : i + n].astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SENT)], schema=_SENT)

    def hits(self, found) -> tuple[np.ndarray, np.ndarray]:
        """Row and start of each window that a smaller document has."""
        hit = np.zeros(int(self.size.sum()), bool)
        for x in found or ():
            hit[np.frombuffer(x, np.int32)] = True
        row, start, which = self.row, self.start, self.which
        n = self.size[which]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        later = np.repeat(self.own[row] > self.least[which], n)
        keep = later | hit[np.repeat(self.at[which], n) + step]
        return np.repeat(row, n)[keep], (np.repeat(start, n) + step)[keep]


def nodes(common: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(depth, first leaf, last leaf, depth of the node above) of the inner nodes of a suffix tree.

    The leaves are suffixes in order; common[i] is what leaves i and i + 1 have in common.  A
    node opens where leaves begin to agree on more and closes where they agree on less.
    """
    stack = [(0, 0)]
    for leaf, shared in enumerate([*common, 0]):
        first = leaf
        while stack[-1][0] > shared:
            depth, first = stack.pop()
            yield depth, first, leaf, max(shared, stack[-1][0])
        if stack[-1][0] < shared:
            stack.append((shared, first))


def words_in_common(a: bytes, b: bytes) -> int:
    """Of two suffixes, each word of which ends with a space."""
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return a.count(b" ", 0, n - (apart.bit_length() + 7) // 8)


def subtree(rows: list[tuple], width: int) -> Iterator[tuple[int, int]]:
    """(chunk, place) of each window of an anchor's neighbourhoods (text, doc, chunk, at) that one of a smaller document has.

    Builds the tree of the suffixes that begin at the windows.  A node of ``width`` words or more
    under one of less is the first at which all leaves share a window.
    """
    rows_of: dict[bytes, list[tuple]] = {}  # copies of a text are one: its suffixes are in the tree once
    for text, *row in rows:
        rows_of.setdefault(text, []).append(row)
    leaves, lowest = [], []
    for own, (text, copies) in enumerate(rows_of.items()):
        least = min(doc for doc, _, _ in copies)
        text += b" "
        n, place = text.count(b" ") - width + 1, 0
        for i in range(n):
            leaves.append((text[place:], least, own, i))
            place = text.index(b" ", place) + 1
        lowest.append([least] * n)
    if len(rows_of) > 1:
        leaves.sort()
        common = [words_in_common(x[0], y[0]) for x, y in zip(leaves, leaves[1:])]
        for depth, first, last, above in nodes(common):
            if depth >= width > above:
                below = leaves[first : last + 1]
                least = min(x[1] for x in below)
                for _, _, own, i in below:
                    lowest[own][i] = least
    for copies, least in zip(rows_of.values(), lowest):
        for doc, chunk, at in copies:
            if doc > min(least):
                yield from ((chunk, at + i) for i, x in enumerate(least) if doc > x)


def _packed(chunk: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Places by chunk."""
    by = np.lexsort((at, chunk))
    chunk, at = chunk[by], at[by].astype(np.int32)
    cut = np.flatnonzero(np.diff(chunk, prepend=chunk[:1] - 1))
    return chunk[cut], [at[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)])]


def met(b: pa.RecordBatch) -> pa.RecordBatch:
    """Of sorted neighbourhoods those whose anchor a neighbour has too, and the first and the last."""
    n = b.num_rows
    if n < 3:
        return b
    anchor = b.column("anchor")
    same = pc.equal(anchor.slice(1), anchor.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return b.filter(pa.array(np.r_[True, same] | np.r_[same, True]))


def grown(sent: DataFrame, width: int) -> DataFrame:
    """chunk, found: the places of windows that a smaller document has."""
    held = HELD

    def answers(hits: list[tuple[int, int]]) -> pa.RecordBatch:
        chunk, found = _packed(*np.array(hits, np.int64).T)
        none = [None] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((chunk, found, none, none, none), _JUDGED)], schema=_JUDGED)

    def apart(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for text, doc, chunk, at in rows:
            place = [0, *accumulate([len(w) + 1 for w in text.split(b" ")])]
            windows = [text[a : b - 1] for a, b in zip(place, place[width:])]
            n = len(windows)
            columns = ([chunk] * n, [None] * n, windows, [doc] * n, range(at, at + n))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _JUDGED)], schema=_JUDGED)

    def run(batches: Iterator[pa.RecordBatch]):
        now, size, crowded, last, hits = [], 0, False, None, []
        for b in batches:
            b = met(b)
            for anchor, *row in zip(*(b.column(c).to_pylist() for c in ("anchor", "text", "doc", "chunk", "at"))):
                if anchor != last:
                    if len(now) > 1:
                        hits += subtree(now, width)
                        if len(hits) > PACK:
                            yield answers(hits)
                            hits = []
                    now, size, crowded, last = [], 0, False, anchor
                if crowded:
                    yield from apart([row])
                    continue
                now.append(row)
                size += len(row[0])
                if size > held:
                    yield from apart(now)
                    now, crowded = [], True
        if len(now) > 1:
            hits += subtree(now, width)
        if hits:
            yield answers(hits)

    ordered = sent.repartition("part").sortWithinPartitions("anchor")
    judged = staged(ordered.select("anchor", "text", "doc", "chunk", "at").mapInArrow(run, _JUDGED_DDL), "judged")
    found = judged.where("suffix is null").select("chunk", "found")
    left = judged.where("suffix is not null")
    if not left.limit(1).count():
        return found
    return found.unionByName(counted(left.select("suffix", "doc", "chunk", "at")))


def counted(leaves: DataFrame) -> DataFrame:
    """chunk, found: of windows one by one (suffix, doc, chunk, at) the places of those whose text a smaller document has.

    A text's smallest document is found before anything is shuffled, once in each task; where a
    text is that of very many windows, Spark splits it in the join.
    """
    least = leaves.groupBy("suffix").agg(F.min("doc").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                found = _packed(b.column("chunk").to_numpy(), b.column("at").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, _FOUND)], schema=_FOUND)

    return leaves.join(least, "suffix").where("doc > least").select("chunk", "at").mapInArrow(run, "chunk long, found binary")


def repeats(docs: DataFrame, unit: Unit, finish: Callable, schema: str, chunk: int = CHUNK) -> DataFrame:
    """finish(rows, texts, marks) -> record batch, for each chunk: marks[i] are the starts of
    document i's windows that start in a document of smaller id too."""
    store = Store(docs, unit, True, chunk)
    first = bounds(store, unit.width)

    def send(batches):
        for b in batches:
            for number, data, samples in zip(b.column("chunk").to_pylist(), b.column("rows"), b.column("samples").to_pylist()):
                yield from Neighbourhoods(Chunk(data.as_py(), unit, True), samples).send(number, first)

    def judge(batches):
        for b in batches:
            for data, samples, found in zip(b.column("rows"), b.column("samples").to_pylist(), b.column("found").to_pylist()):
                c = Chunk(data.as_py(), unit, True)
                row, start = Neighbourhoods(c, samples).hits(found)
                yield finish(c.rows, c.texts, by_row(row, start, len(c.texts)))

    back = grown(store.joined.mapInArrow(send, _SENT_DDL), unit.width).groupBy("chunk").agg(F.collect_list("found").alias("found"))
    return store.answered(back, "found").mapInArrow(judge, schema)
