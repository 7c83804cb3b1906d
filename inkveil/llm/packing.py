"""Best-fit packing by large-item matching (operator 9).

Only the number of pieces of each length matters for a packing, and lengths end at the
capacity.  So the plan is made from one count for each length (at most ``capacity`` rows,
whatever the corpus) and says how many sequences get which lengths:

* pieces above a third of the capacity ("large") go at most two to a sequence; the longest
  left is matched with the longest other large piece that still fits;
* shorter pieces, longest first, go to the smallest gap that takes them, else to new
  sequences.

Each piece has a rank among those of its length: the rank within its chunk (a task of the
tokenizing pass, fixed as that pass's rows are written) plus the earlier chunks' counts.
Length and rank give its sequence and offset; no piece meets all others anywhere.

Null texts count as empty; every document ends with the separator id, so an empty one has
one token.  Repeated rows are packed as documents of their own.  An empty table gives an
empty result.  Further columns of the table are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import batch, keyed_texts, pieces_of, staged

CAPACITY, SEPARATOR = 1024, 2
PIECES = pa.schema(
    [
        ("chunk", pa.int64()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("nth", pa.int64()),
    ]
)
PIECES_DDL = "chunk long, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def json_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a byte-level BPE file of the tokenizers library; its special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


def json_added(path: str) -> dict[str, int]:
    """The file's added tokens, which the tokenizers library finds in texts before anything else."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", ())
    for t in added:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"the added token {t['content']!r} takes account of what is around it")
    return {t["content"]: t["id"] for t in added}


_encodings: dict[str, tiktoken.Encoding] = {}


def _encoding(path: str) -> tiktoken.Encoding:
    """The file's vocabulary in the faster of the libraries that give its ids; added tokens in a text have their own."""
    if path not in _encodings:
        _encodings[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=json_ranks(path), special_tokens=json_added(path))
    return _encodings[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first can be shorter than the capacity."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def piece_table(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        encode = _encoding(path).encode_to_numpy
        chunk, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in pieces_of(batches, rows=4096, size=4 << 20):
            rows = {name: [] for name in PIECES.names}
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = memoryview(encode(text, allowed_special="all").astype("<u4").tobytes() + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    values = (chunk, doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length])
                    seen[length] += 1
                    for name, value in zip(PIECES.names, values):
                        rows[name].append(value)
            yield batch(rows, PIECES)

    return keyed_texts(docs).mapInArrow(run, PIECES_DDL)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(sequences, lengths in each)] from the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    by_gap: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)

    def put(many: int, lengths: list[int]) -> None:
        if many:
            by_gap[capacity - sum(lengths)].append((many, lengths))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m + n <= capacity and left[m] > (m == n)), None)
            if mate is None:
                put(left[n], [n])
                left[n] = 0
            else:
                many = left[n] // 2 if mate == n else min(left[n], left[mate])
                put(many, [n, mate])
                left[n] -= many
                left[mate] -= many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in range(n, capacity):
            while left[n] and by_gap.get(gap):
                many, lengths = by_gap[gap].pop()
                each = gap // n
                full, rest = min(many, left[n] // each), 0
                if full < many:
                    rest = left[n] - full * each
                put(full, lengths + [n] * each)
                if rest:
                    put(1, lengths + [n] * rest)
                untouched = many - full - (rest > 0)
                left[n] -= full * each + rest
                if untouched:
                    put(untouched, lengths)
        if left[n]:
            each = capacity // n
            put(left[n] // each, [n] * each)
            if left[n] % each:
                put(1, [n] * (left[n] % each))
            left[n] = 0
    return [x for gap in sorted(by_gap) for x in by_gap[gap]]


def slots(blocks: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of ranks: those of one length from ``first`` on go to ``sequence``, +1, ... at ``offset``."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for many, lengths in blocks:
        offset = 0
        for n in lengths:
            runs[n].append((used[n], sequence, offset))
            used[n] += many
            offset += n
        sequence += many
    before, rows = {}, []
    total = 0
    for n in sorted(runs):
        before[n] = total
        rows += [(total + first, seq, off) for first, seq, off in runs[n]]
        total += used[n]
    base = np.zeros(capacity + 1, np.int64)
    for n, b in before.items():
        base[n] = b
    out = np.array(rows, np.int64).reshape(-1, 3)
    return {"base": base, "first": out[:, 0], "sequence": out[:, 1], "offset": out[:, 2]}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(piece_table(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity, separator), "pieces")
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most `capacity` rows, however large the corpus.
    of_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = slots(plan(of_length, capacity), capacity)

    rank = F.lit(0).cast("long") + F.get(_longs(found["base"]), F.col("length").cast("int")) + F.col("before") + F.col("nth")
    placed = pieces.join(base, ["chunk", "length"]).withColumn("rank", rank)
    placed = placed.withColumn("at", _last_not_above(found["first"], F.col("rank")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.get(_longs(found["sequence"]), F.col("at")) + F.col("rank") - F.get(_longs(found["first"]), F.col("at"))).alias("sequence_id"),
        F.get(_longs(found["offset"]), F.col("at")).alias("offset"),
    )


def _longs(values: np.ndarray) -> Column:
    """A constant array; one literal, however long."""
    return F.split(F.lit(",".join(map(str, values.tolist())) or "0"), ",").cast("array<bigint>")


def _last_not_above(ascending: np.ndarray, value: Column) -> Column:
    """The index of the last number that is not above value, by bisection."""
    numbers = _longs(ascending)

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        up = F.get(numbers, mid) <= value
        return F.struct(F.when(up, mid).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(mid).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(max(1, len(ascending))).alias("high"))
    rounds = F.sequence(F.lit(1), F.lit(max(1, int(len(ascending)).bit_length())))
    return F.aggregate(rounds, start, halve)["low"]
