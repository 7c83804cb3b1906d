"""PDF files as a source: pages, and their rasters, from Spark's file reader.

Files are dealt to tasks by Spark and read where they lie; a file has 25 MB at most
(``files.reject_reason``).  A file that is protected or damaged gives one row with a reason
and never fails the job.  What a page needs to be drawn is in ``operators.render``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from . import files

PROTECTED = "This PDF needs a password and stays closed."
DAMAGED = "This PDF is damaged or not a PDF."
MOST = 256 << 20  # bytes that a stream may unpack to

_SPACE, _STOP = rb"\0\t\n\f\r ", rb"\0\t\n\f\r ()<>\[\]{}/%"
_TOKEN = re.compile(rb"(?:[" + _SPACE + rb"]|%[^\r\n]*)*(<<|>>|[\[\]{}()]|/[^" + _STOP + rb"]*|<[0-9A-Fa-f" + _SPACE + rb"]*>|[^" + _STOP + rb"]+)")
_REF = re.compile(rb"[" + _SPACE + rb"]+(\d+)[" + _SPACE + rb"]+R(?![^" + _STOP + rb"])")
_OBJ = re.compile(rb"(?<!\d)(\d{1,10})[" + _SPACE + rb"]+(\d{1,5})[" + _SPACE + rb"]+obj\b")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")


class Damaged(ValueError):
    pass


class Protected(ValueError):
    pass


class Name(str):
    __slots__ = ()


class Ref(int):
    """The number of an object."""

    __slots__ = ()


class Word(bytes):
    """A bare word: an operator in contents."""

    __slots__ = ()


@dataclass
class Stream:
    head: dict
    raw: bytes


@dataclass
class Page:
    box: tuple[float, float, float, float]
    rotate: int
    resources: dict
    contents: bytes
    trouble: list[str] = field(default_factory=list)


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            c = data[at : at + 1]
            at += 1
            if c in b"01234567" and c:
                octal = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2]).group()
                out.append(int(octal, 8) & 255)
                at += len(octal) - 1
            elif c == b"\r":
                at += data[at : at + 1] == b"\n"
            elif c != b"\n":
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    raise Damaged("a string has no end")


def parse(data: bytes, at: int, refs: bool = True, depth: int = 0):
    """(object, where it ends)."""
    if depth > 60:
        raise Damaged("nested too deep")
    if not (m := _TOKEN.match(data, at)):
        raise Damaged("an object is missing")
    token, at = m.group(1), m.end()
    if token == b"<<":
        out = {}
        while (m := _TOKEN.match(data, at)) and m.group(1) != b">>":
            key, at = parse(data, at, refs, depth + 1)
            out[key if isinstance(key, str) else str(key)], at = parse(data, at, refs, depth + 1)
        if not m:
            raise Damaged("a dictionary has no end")
        return out, m.end()
    if token == b"[":
        out = []
        while (m := _TOKEN.match(data, at)) and m.group(1) != b"]":
            value, at = parse(data, at, refs, depth + 1)
            out.append(value)
        if not m:
            raise Damaged("an array has no end")
        return out, m.end()
    if token == b"(":
        return _string(data, at)
    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if token[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), token[1:]).decode("latin-1")), at
    if _NUMBER.match(token):
        if refs and token.isdigit() and (m := _REF.match(data, at)):
            return Ref(token), m.end()
        return (float(token) if b"." in token else int(token)), at
    return {b"true": True, b"false": False, b"null": None}.get(token, Word(token)), at


def _unpredicted(data: bytes, parms: dict) -> bytes:
    kind, colours, bits, columns = (int(parms.get(k, d)) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind == 1:
        return data
    if not (0 < colours < 33 and bits in (1, 2, 4, 8, 16) and 0 < columns < 1 << 20):
        raise Damaged("a predictor is wrong")
    step, width = max(1, colours * bits // 8), -(-columns * colours * bits // 8)
    if kind == 2:
        if bits != 8:
            raise Damaged("a predictor that is not read")
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colours)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    rows = np.frombuffer(data[: len(data) // (width + 1) * (width + 1)], np.uint8).reshape(-1, width + 1)
    out, above = np.zeros((len(rows), width), np.uint8), np.zeros(width, np.uint8)
    for i, row in enumerate(rows):
        how, line = row[0], row[1:].copy()
        if how == 2:
            line += above
        elif how == 1:
            padded = np.pad(line, (0, -width % step)).reshape(-1, step)
            line = np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[:width]
        elif how > 2:
            mine, up = line.tolist(), above.tolist()
            for k in range(width):
                a = mine[k - step] if k >= step else 0
                b, c = up[k], up[k - step] if k >= step else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                mine[k] = (mine[k] + guess) & 255
            line = np.array(mine, np.uint8)
        out[i] = above = line
    return out.tobytes()


def _inflate(data: bytes) -> bytes:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, MOST)
    except zlib.error as e:
        raise Damaged("a packed stream is wrong") from e
    if z.unconsumed_tail:
        raise Damaged("a stream unpacks to too much")
    return out


def _ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[" + _SPACE + rb"]", b"", data).split(b"~")[0]
    out = bytearray()
    for group in re.findall(rb"z|[!-u]{1,5}", data):
        digits = b"!!!!!" if group == b"z" else group.ljust(5, b"u")
        value = 0
        for d in digits:
            value = value * 85 + d - 33
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: 4 if group == b"z" else len(group) - 1]
    return bytes(out)


def _run_lengths(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (n := data[at]) != 128:
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


class File:
    """The objects of a PDF, each read when it is asked for."""

    def __init__(self, data: bytes):
        start = data.find(b"%PDF-", 0, 1024)
        if start < 0:
            raise Damaged("no header")
        self.data = data[start:]
        self.at: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.known: dict[int, object] = {}
        try:
            self._read_table()
            if not isinstance(self.get(self.get(self.trailer.get("Root")).get("Pages")), dict):
                raise Damaged("no pages")
        except (ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError):
            self._search()
        if self.trailer.get("Encrypt") is not None:
            raise Protected

    def _read_table(self) -> None:
        hits = re.findall(rb"startxref[" + _SPACE + rb"]+(\d+)", self.data[-2048:])
        todo, seen = [int(hits[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if m := re.compile(rb"[" + _SPACE + rb"]*xref").match(self.data, at):
                head = self._table(m.end())
            else:
                head = self._table_stream(at)
            self.trailer = head | self.trailer
            todo += [int(head[k]) for k in ("XRefStm", "Prev") if k in head]
        if "Root" not in self.trailer:
            raise Damaged("no root")

    def _table(self, at: int) -> dict:
        part = re.compile(rb"[" + _SPACE + rb"]*(\d+)[" + _SPACE + rb"]+(\d+)[" + _SPACE + rb"]*(?=\d{10} )")
        while m := part.match(self.data, at):
            first, n = int(m.group(1)), int(m.group(2))
            at = m.end()
            for k in range(min(n, (len(self.data) - at) // 18)):
                entry = re.compile(rb"[" + _SPACE + rb"]*(\d{10}) (\d{5}) ([nf])").match(self.data, at)
                at = entry.end()
                if entry.group(3) == b"n":
                    self.at.setdefault(first + k, ("at", int(entry.group(1))))
        word, at = parse(self.data, at)
        if word != b"trailer":
            raise Damaged("no trailer")
        return parse(self.data, at)[0]

    def _table_stream(self, at: int) -> dict:
        own = self._object(at)
        wide, head = own.head["W"], own.head
        data = self.decoded(own)[0]
        pairs = head.get("Index") or [0, head["Size"]]
        at = 0
        for first, n in zip(pairs[::2], pairs[1::2]):
            for k in range(first, first + n):
                values = []
                for w in wide:
                    values.append(int.from_bytes(data[at : at + w], "big") if w else None)
                    at += w
                kind = 1 if values[0] is None else values[0]
                if at > len(data):
                    break
                if kind == 1:
                    self.at.setdefault(k, ("at", values[1]))
                elif kind == 2:
                    self.at.setdefault(k, ("in", values[1], values[2] or 0))
        return head

    def _search(self) -> None:
        """The objects by their marks, where the table does not say; later ones count."""
        self.at, self.known = {int(m.group(1)): ("at", m.start()) for m in _OBJ.finditer(self.data)}, {}
        self.trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= parse(self.data, m.end())[0]
            except (ValueError, TypeError):
                continue
        for number in list(self.at):
            own = self.get(Ref(number))
            head = own.head if isinstance(own, Stream) else own if isinstance(own, dict) else {}
            if head.get("Type") == "ObjStm":
                for k, (inner, _) in enumerate(self._index(own)):
                    self.at.setdefault(inner, ("in", number, k))
            elif head.get("Type") == "XRef":
                self.trailer = {k: v for k, v in head.items() if k in ("Root", "Encrypt")} | self.trailer
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            roots = [n for n in self.at if isinstance(own := self.get(Ref(n)), dict) and own.get("Type") == "Catalog"]
            if not roots:
                raise Damaged("no root")
            self.trailer["Root"] = Ref(roots[-1])

    def _object(self, at: int):
        m = _OBJ.match(self.data, re.compile(rb"[" + _SPACE + rb"]*").match(self.data, at).end())
        if not m:
            raise Damaged("no object there")
        value, at = parse(self.data, m.end())
        if isinstance(value, dict) and (m := re.compile(rb"[" + _SPACE + rb"]*stream(\r\n|\n|\r)?").match(self.data, at)):
            size = self.get(value.get("Length"))
            start = m.end()
            end = start + size if isinstance(size, int) and size >= 0 else -1
            if end < 0 or not re.compile(rb"[" + _SPACE + rb"]*endstream").match(self.data, end):
                end = self.data.find(b"endstream", start)
                if end < 0:
                    raise Damaged("a stream has no end")
            return Stream(value, self.data[start:end])
        return value

    def _index(self, own: Stream) -> list[tuple[int, int]]:
        data = self.decoded(own)[0]
        numbers = [int(x) for x in data[: self.get(own.head["First"])].split()]
        return list(zip(numbers[::2], numbers[1::2]))

    def get(self, value):
        """What a reference stands for, null for what is missing or wrong; other values as they are."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            if value not in self.known:
                self.known[value] = None  # also ends references that go round
                try:
                    place = self.at.get(value)
                    if place and place[0] == "at":
                        self.known[value] = self._object(place[1])
                    elif place:
                        own = self.get(Ref(place[1]))
                        start = self._index(own)[place[2]][1]
                        self.known[value] = parse(self.decoded(own)[0], self.get(own.head["First"]) + start)[0]
                except (ValueError, TypeError, KeyError, IndexError, AttributeError):
                    pass
            value = self.known[value]
        return None

    def decoded(self, own: Stream) -> tuple[bytes, str | None, dict]:
        """(bytes, the filter that is left, its parameters): image codecs stay packed."""
        names, parms = self.get(own.head.get("Filter", own.head.get("F"))), self.get(own.head.get("DecodeParms", own.head.get("DP")))
        names = [self.get(n) for n in names] if isinstance(names, list) else [names] if names else []
        parms = [self.get(p) or {} for p in parms] if isinstance(parms, list) else [parms or {}] * len(names)
        data = own.raw
        for name, p in zip(names, [*parms, *[{}] * len(names)]):
            if name in ("FlateDecode", "Fl"):
                data = _unpredicted(_inflate(data), {k: self.get(v) for k, v in p.items()})
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif name in ("RunLengthDecode", "RL"):
                data = _run_lengths(data)
            else:
                return data, str(name), p
        return data, None, {}

    def pages(self) -> Iterator[Page]:
        """Pages in order, with what they inherit."""
        root = self.get(self.get(self.trailer.get("Root")).get("Pages"))
        todo, seen = [(root, {})], set()
        while todo:
            node, held = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            held = held | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(self.get(k), held) for k in reversed(kids)]
            elif node.get("Type", "Page") == "Page":
                yield self._page(node, held)

    def _page(self, node: dict, held: dict) -> Page:
        def box(key):
            try:
                a, b, c, d = (float(self.get(v)) for v in self.get(held.get(key)))
            except (TypeError, ValueError):
                return None
            return (min(a, c), min(b, d), max(a, c), max(b, d))

        media = box("MediaBox") or (0.0, 0.0, 612.0, 792.0)
        crop = box("CropBox") or media
        cut = (max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3]))
        used = cut if cut[2] > cut[0] and cut[3] > cut[1] else media
        rotate = self.get(held.get("Rotate")) or 0
        contents, trouble = self.get(node.get("Contents")), []
        parts = []
        for part in contents if isinstance(contents, list) else [contents]:
            own = self.get(part)
            if isinstance(own, Stream):
                try:
                    data, left, _ = self.decoded(own)
                    if left:
                        trouble.append(f"filter {left}")
                    else:
                        parts.append(data)
                except ValueError:
                    trouble.append("damaged contents")
        resources = self.get(held.get("Resources"))
        return Page(used, int(rotate) % 360 if isinstance(rotate, (int, float)) else 0, resources if isinstance(resources, dict) else {}, b"\n".join(parts), trouble)


def opened(data: bytes) -> tuple[File | None, list[Page], str | None]:
    """(file, pages, no reason) or (no file, no pages, reason)."""
    try:
        own = File(data)
        pages = list(own.pages())
    except Protected:
        return None, [], PROTECTED
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
        return None, [], DAMAGED
    return (own, pages, None) if pages else (None, [], DAMAGED)


RASTER = pa.schema([
    ("doc_id", pa.int64()), ("page_no", pa.int32()), ("page_count", pa.int32()), ("width", pa.int32()), ("height", pa.int32()),
    ("pixels", pa.binary()), ("not_drawn", pa.list_(pa.string())), ("reason", pa.string()), ("source_name", pa.string()),
])
_RASTER = "doc_id long, page_no int, page_count int, width int, height int, pixels binary, not_drawn array<string>, reason string, source_name string"


def pages(docs: DataFrame, edge: int | None = None) -> DataFrame:
    """Pages of PDF files (doc_id, content), drawn on white with a long edge of 2400.

    doc_id, page_no, page_count, width, height, pixels (RGB), not_drawn (what a page holds that
    is not drawn: text, shadings, codecs) and reason.  A file that can't be opened, and a null
    one, gives one row without a page but with a reason.  A row a page leaves a task at a time.
    """
    from ..operators import render

    edge = edge or render.EDGE

    def run(batches):
        for b in batches:
            for doc_id, name, content in zip(b.column("doc_id").to_pylist(), b.column("source_name").to_pylist(), b.column("content")):
                own, found, reason = opened(content.as_py() or b"")
                if reason:
                    yield _row(doc_id, None, None, None, None, None, None, reason, name)
                for i, page in enumerate(found):
                    pixels, missed = render.draw(own, page, edge)
                    yield _row(doc_id, i, len(found), pixels.shape[1], pixels.shape[0], pixels.tobytes(), missed, None, name)

    def _row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, RASTER.types)], schema=RASTER)

    name = "source_name" if "source_name" in docs.columns else F.lit(None).cast("string").alias("source_name")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), name, "content").mapInArrow(run, _RASTER)


def page_images(docs: DataFrame) -> DataFrame:
    """Packed JPEGs of PDF files as they lie in them: doc_id, page_no, name, jpeg, width, height; or a reason."""
    schema = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("name", pa.string()), ("jpeg", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("reason", pa.string())])

    def run(batches):
        for b in batches:
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content")):
                own, found, reason = opened(content.as_py() or b"")
                rows = [(doc_id, None, None, None, None, None, reason)] if reason else []
                for i, page in enumerate(found):
                    images = own.get(page.resources.get("XObject"))
                    for name, value in images.items() if isinstance(images, dict) else ():
                        image = own.get(value)
                        if isinstance(image, Stream) and image.head.get("Subtype") == "Image":
                            data, left, _ = own.decoded(image)
                            if left in ("DCTDecode", "DCT"):
                                rows.append((doc_id, i, str(name), data, own.get(image.head.get("Width")), own.get(image.head.get("Height")), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, page_no int, name string, jpeg binary, width int, height int, reason string")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the PDF files of a folder as working pages: those of ``pages``, source_name, working size and scale."""
    accepted, _ = files.read_files(spark, path)
    docs = accepted.where(files.is_pdf(F.col("mime"))).select(F.xxhash64("path").alias("doc_id"), "content", F.regexp_extract("path", "([^/]*)\\z", 1).alias("source_name"))
    work_w, work_h, scale = G.work_size(F.col("width"), F.col("height"))
    return pages(docs).withColumns({"work_w": work_w, "work_h": work_h, "scale_to_full": scale, "source_type": F.lit("application/pdf")})
