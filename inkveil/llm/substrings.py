"""Substring dedup of bytes (operator 1) and of words (operator 4).

Operator 1 removes each byte covered by a 400-byte string that also starts anywhere else.
Operator 4 removes each word covered by a 13-word window that also starts in a document with
a smaller doc_id.  Both judge the input, not what is left of it; see ``suffixes`` and ``trees`` for how.

Null texts count as empty.  Repeated rows are documents of their own; for operator 4 equal
doc_ids are not smaller than each other, and a null doc_id is larger than any other.  Texts
shorter than a window keep everything.  Very long texts are judged in overlapping pieces, not
cut.  An empty table gives an empty result.  Further
columns are not read, except by ``keep_first_passages``, which passes them on.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from . import suffixes, trees
from .common import batch, keyed_texts
from .repeats import Sums, Unit, covered

BYTES, WORDS = 400, 13
_BYTE_CODES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_codes(text: bytes) -> np.ndarray:
    return _BYTE_CODES[np.frombuffer(text, np.uint8)]


#: Bytes of text whose words are coded at once; a longer word is coded by itself.
BLOCK = 1 << 18
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_IS_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _coded(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A code for each word, by its bytes, and where the words begin."""
    white = _IS_WHITE[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(white, prepend=True, append=True))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    codes = Sums(byte_codes(text)).of(size, begin)
    for i in np.flatnonzero(size > BLOCK).tolist():
        codes[i] = xxhash.xxh64_intdigest(text[begin[i] : begin[i] + size[i]], 42)
    return codes, begin


def word_codes(text: bytes) -> np.ndarray:
    """A code for each word; long texts are taken in stretches that end between words."""
    out, at = [], 0
    while len(text) - at > 2 * BLOCK:
        cut = _WHITE.search(text, at + BLOCK)
        stretch = text[at : cut.start()] if cut else text[at:]
        if len(stretch) > 2 * BLOCK:
            # Its last word is longer than BLOCK, and is not spread out as numbers.
            *head, word = stretch.rsplit(None, 1)
            out += [_coded(h)[0] for h in head]
            out.append(np.array([xxhash.xxh64_intdigest(word, 42)], np.uint64))
        else:
            out.append(_coded(stretch)[0])
        at = cut.end() if cut else len(text)
    return np.concatenate([*out, _coded(text[at:])[0]])


def codes_of_words(texts: list[bytes]) -> list[np.ndarray]:
    """word_codes of each text, short ones many at a time."""
    out, i = [], 0
    while i < len(texts):
        j, size = i + 1, len(texts[i]) + 1
        while j < len(texts) and size + len(texts[j]) <= BLOCK:
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            out.append(word_codes(texts[i]))
        else:
            codes, begin = _coded(b" ".join(texts[i:j]))
            ends = np.cumsum([len(t) + 1 for t in texts[i : j - 1]])
            out += np.split(codes, np.searchsorted(begin, ends))
        i = j
    return out


# A sample is the smallest 48-gram of 128 bytes, or 6-gram of 13 words.
BYTE_UNIT = Unit(byte_codes, BYTES, 48, 128)
WORD_UNIT = Unit(word_codes, WORDS, 6, 13, codes_of_words)


def spans_removed(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs as (start, end)."""
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def dedup_bytes(docs: DataFrame, width: int = BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: also kept (binary) and the removed spans."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        + ([("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))] if with_text else [])
    )
    span = min(BYTE_UNIT.span, width)
    unit = Unit(byte_codes, width, min(BYTE_UNIT.gram, max(1, span // 2)), span)

    def finish(rows, texts, marks):
        out = {n: [] for n in schema.names}
        out["doc_id"] = rows.column("doc_id").combine_chunks()
        for text, at in zip(texts, marks):
            kept, spans = text, []
            if len(at):
                gone = covered(at, len(text), width)
                spans = spans_removed(gone)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept)
                out["spans"].append(spans)
        return batch(out, schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<array<long>>" if with_text else "")
    return suffixes.repeats(keyed_texts(docs), unit, finish, ddl)


def _word_unit(width: int) -> Unit:
    return WORD_UNIT if width == WORDS else Unit(word_codes, width, max(1, width // 2), width, codes_of_words)


def dedup_words(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(rows, texts, marks):
        out = {n: [] for n in schema.names}
        out["doc_id"] = rows.column("doc_id").combine_chunks()
        for text, at in zip(texts, marks):
            words = text.split()
            n = len(words)
            if len(at):
                gone = covered(at, n, width)
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
        return batch(out, schema)

    return trees.repeats(keyed_texts(docs), _word_unit(width), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def keep_first_passages(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """docs with the words of later passages removed from text, the kept ones joined by a space,
    and n_chars (if there, as a whole number) counted anew.  Untouched rows stay as they are; rows
    of which nothing is left go."""
    names = docs.columns
    counted = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, IntegralType)
    # Plain names for what only passes through: Python stages take no names with dots.
    shaped = docs.withColumn("doc_id", F.col("doc_id").cast("long")).toDF(*[c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(names)])

    def finish(rows, texts, marks):
        new, stay = rows.column("text").to_pylist(), np.ones(len(texts), bool)
        sizes = rows.column("n_chars").to_pylist() if counted else None
        for i, (text, at) in enumerate(zip(texts, marks)):
            if len(at):
                words = text.split()
                gone = covered(at, len(words), width).tolist()
                new[i] = b" ".join([w for w, g in zip(words, gone) if not g]).decode()
                stay[i] = bool(new[i])
                if sizes is not None:
                    sizes[i] = len(new[i])
        for name, values in (("text", new), ("n_chars", sizes)):
            if values is not None:
                at = rows.schema.get_field_index(name)
                rows = rows.set_column(at, rows.schema.field(at), pa.array(values, rows.schema.field(at).type))
        kept = rows.filter(pa.array(stay)).combine_chunks()
        return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], kept.schema)

    return trees.repeats(shaped, _word_unit(width), finish, shaped.schema).toDF(*names)
