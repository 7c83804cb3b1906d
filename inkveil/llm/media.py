"""FLAC media columns (operator 3): text payloads stored as sound, read back, described.

Null texts count as empty.  Texts are taken whole; a payload is the text's UTF-8 and bytes 0
up to a positive multiple of 64.  Equal texts give equal values.  Repeated rows stay; an
empty table gives an empty result; further columns are not read.  No shuffle: each task
codes and decodes its own rows, some megabytes at a time.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import flac
from .common import batch, keyed_texts, pieces_of

UNIT = 64
ROUND_TRIP = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ]
)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(-len(data) % unit if data else unit)


def feature(samples: np.ndarray) -> str:
    """Samples, peak, mean and root mean square (times 1000, rounded down), zero crossings."""
    if not len(samples):
        return "n=0"
    total, squares = int(samples.sum()), int((samples * samples).sum())
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    return f"n={len(samples)};peak={int(np.abs(samples).max())};mean={total * 1000 // len(samples)};rms={int((squares / len(samples)) ** 0.5 * 1000)};zc={crossings}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a FLAC stream."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in pieces_of(batches, rows=2000, size=4 << 20):
            raw = [t.encode() for t in b.column("text").to_pylist()]
            yield batch({"doc_id": b.column("doc_id"), "n_bytes": list(map(len, raw)), "media": flac.encode(list(map(padded, raw)))}, out)

    return keyed_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row for each frame of a media column: sample_offset, samples, byte_offset (of the frame in the stream), pcm.

    Rows whose media is null, or is no readable stream, give one row with ``error``.
    """
    out = pa.schema(
        [("doc_id", pa.int64()), ("sample_offset", pa.int64()), ("samples", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())]
    )

    def run(batches):
        for b in batches:
            rows = {n: [] for n in out.names}
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                try:
                    info = flac.metadata(data or b"")
                    (samples,) = flac.decode([data])
                    points = info.points or [(0, 0, len(samples))]
                    found = [(doc_id, a, n, info.audio + at, flac.pcm(samples[a : a + n], info.bits), None) for a, at, n in points]
                except ValueError as e:
                    found = [(doc_id, None, None, None, None, str(e))]
                for row in found:
                    for n, v in zip(out.names, row):
                        rows[n].append(v)
            yield batch(rows, out)

    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, sample_offset long, samples long, byte_offset long, pcm binary, error string"
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores each payload as FLAC, reads the stored bytes back and digests both."""

    def run(batches):
        for b in pieces_of(batches, rows=2000, size=4 << 20):
            raw = [t.encode() for t in b.column("text").to_pylist()]
            media = flac.encode(list(map(padded, raw)))
            rows = {n: [] for n in ROUND_TRIP.names}
            rows["doc_id"] = b.column("doc_id")
            for data, stream, samples in zip(raw, media, flac.decode(media)):
                payload = (samples + 128).astype(np.uint8).tobytes()
                rows["n_bytes"].append(len(data))
                rows["payload_bytes"].append(len(payload))
                rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
                rows["media_bytes"].append(len(stream))
                rows["media_sha256"].append(hashlib.sha256(stream).hexdigest())
                rows["feature"].append(feature(samples))
            yield batch(rows, ROUND_TRIP)

    return keyed_texts(docs).mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
