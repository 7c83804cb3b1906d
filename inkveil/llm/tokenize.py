"""Corpus tokenization with the BPE transducer (operator 7).

Null texts count as empty; an empty text has no tokens and the digest of no bytes.
Repeated rows give repeated rows; an empty table gives an empty result; further columns of
the table are not read.  Texts are encoded whole, one at a time, without a shuffle.
"""

from __future__ import annotations

import hashlib
from operator import itemgetter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Pieces, Utf8Machine, encoder
from .common import batch, keyed_texts, pieces_of

IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("n_chars", pa.int64()),
    ]
)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids: the token ids of each whole text."""
    path = path or vocabulary_path()

    def run(batches):
        e = encoder(path, pattern)
        for b in pieces_of(batches, rows=4096, size=4 << 20):
            ids = [e.encode(t) for t in b.column("text").to_pylist()]
            yield batch({"doc_id": b.column("doc_id"), "ids": ids}, IDS)

    return keyed_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, text: decoded through the incremental UTF-8 machine."""
    path = path or vocabulary_path()
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        e = encoder(path, pattern)
        for b in batches:
            texts = ["".join(e.decode_stream(ids or ())) for ids in b.column("ids").to_pylist()]
            yield batch({"doc_id": b.column("doc_id"), "text": texts}, out)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encodes every text, decodes its ids again and returns counts and digests of both."""
    path = path or vocabulary_path()
    step = 1 << 16

    def run(batches):
        e = encoder(path, pattern)
        tokens = e.vocabulary.tokens
        # Of each piece: how many ids, their text, and what these ids decode to.
        memo = Pieces(e.piece, lambda ids: (len(ids), " ".join(map(str, ids)), b"".join([tokens[i] for i in ids])), 400_000)
        count, text_of, bytes_of = itemgetter(0), itemgetter(1), itemgetter(2)
        for b in pieces_of(batches, rows=4096, size=4 << 20):
            rows = {name: [] for name in DIGEST.names}
            for text in b.column("text").to_pylist():
                found = list(map(memo.__getitem__, e.pattern.findall(text)))
                decoded, machine, n_chars = hashlib.sha256(), Utf8Machine(), 0
                for at in range(0, len(found), step):
                    data = b"".join(map(bytes_of, found[at : at + step]))
                    decoded.update(data)
                    n_chars += len(machine.feed(data))
                rows["n_tokens"].append(sum(map(count, found)))
                rows["ids_sha256"].append(hashlib.sha256(" ".join(map(text_of, found)).encode()).hexdigest())
                rows["decoded_sha256"].append(decoded.hexdigest())
                rows["n_chars"].append(n_chars + len(machine.close()))
            rows["doc_id"] = b.column("doc_id")
            yield batch(rows, DIGEST)

    return keyed_texts(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long"
    )
