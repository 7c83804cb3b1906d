"""Byte-level BPE by a lazily determinised finite-state transducer (operator 7).

A vocabulary of ranks gives every byte string exactly one BPE segmentation, and the
segmentations of all prefixes of a string form a tree: the last token of a prefix joins
the segmentation of a shorter prefix.  The transducer keeps only the prefixes that a
future token could still start at (those whose remaining bytes begin some token).  Once
all of their segmentations agree on leading tokens, these are final and are emitted; a
token therefore waits for at most (longest token - 1) bytes.  What is kept, made relative
to the last emitted token, is the state; states and transitions are built when first
needed and remembered.

Two neighbouring tokens are in order iff plain BPE of their joined bytes gives these two
tokens, that is, iff no merge across their border comes up while both of its sides exist.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from itertools import chain

import regex

START = -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self._split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self.known: dict[int, bool] = {}  # by a, b < 2**20

    def merge(self, data: bytes, below: int | None = None) -> list[bytes]:
        """Plain BPE: the lowest-ranked neighbouring pair first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (below is None or r < below) and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: bytes):
        """The two parts that the token's last merge joins; None for bytes and unreachable tokens."""
        if token not in self._split:
            parts = self.merge(token, self.ranks[token]) if len(token) > 1 else [token]
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[token]

    def _spine(self, token: int, side: int, memo: dict) -> list[tuple[bytes, float]]:
        """Parts at the token's edge, each with the rank of the merge that ends it."""
        if token not in memo:
            part, ends, out = self.tokens[token], float("inf"), []
            while True:
                out.append((part, ends))
                halves = self.split(part)
                if halves is None:
                    break
                ends, part = self.ranks[part], halves[side]
            memo[token] = out
        return memo[token]

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.known.get(key)
        if known is None:
            ranks, known = self.ranks, True
            left = self._spine(b, 0, self._left)
            for x, x_ends in self._spine(a, 1, self._right) if a != START else ():
                for y, y_ends in left:
                    r = ranks.get(x + y)
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[key] = known
        return known


class _Open:
    """An unfinished beginning of a token: what each next byte completes, what stays, what comes next."""

    __slots__ = ("arcs", "text")

    def __init__(self, text: bytes):
        self.text = text
        self.arcs: dict[int, tuple] = {}


class Transducer:
    """Bytes in, token ids out.

    A state is the last emitted token, the longest unfinished beginning of a token that the
    input ends in, and for each live prefix (one for each unfinished beginning, the longest
    first, and the whole input) its tokens since the last emitted one.

    States become determined lazily, one for each input that leaves the known ones: its first
    unknown arc is remembered, the rest of the input runs without being remembered.  So what
    recurs is known after a few visits, and what never does costs no memory.  At most
    ``max_states`` are kept; beyond that all are forgotten, which changes no output.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = 250_000):
        self.v = vocabulary
        self.max_states = max_states
        self.opens: dict[bytes, _Open] = {}
        self._reset()

    def _reset(self) -> None:
        start = (START, self._open(b""), ((),))
        self.states = [start]
        self.number = {start: 0}
        self.arcs: dict[int, tuple[tuple, int]] = {}  # by 256 * state + byte

    def _open(self, text: bytes) -> _Open:
        found = self.opens.get(text)
        if found is None:
            found = self.opens[text] = _Open(text)
        return found

    def _end(self, open_: _Open, byte: int) -> tuple:
        """What one more byte does to the unfinished beginnings: the tokens it completes and
        the beginnings that stay, both by the live prefixes they start at, and the longest."""
        v, text, whole = self.v, open_.text, open_.text + bytes((byte,))
        starts = [i for i in range(len(text) + 1) if i == len(text) or text[i:] in v.prefixes]
        done = tuple((n, v.ranks[whole[i:]]) for n, i in enumerate(starts) if whole[i:] in v.ranks)
        stay = tuple(n for n, i in enumerate(starts) if whole[i:] in v.prefixes)
        found = open_.arcs[byte] = (done, stay, self._open(whole[starts[stay[0]] :] if stay else b""))
        return found

    def _run(self, state: tuple, data: bytes, out: list[int]) -> tuple:
        """Reads data from a state, adds what becomes final to out, and returns the state reached."""
        last, open_, live = state
        known, follows = self.v.known, self.v.follows
        for byte in data:
            done, stay, open_ = open_.arcs.get(byte) or self._end(open_, byte)
            for n, token in done:
                path = live[n]
                a = path[-1] if path else last
                ok = known.get(a << 20 | token)
                if ok or ok is None and follows(a, token):
                    break
            else:
                raise ValueError("the vocabulary gives no segmentation: a byte is missing")
            kept = [live[n] for n in stay]
            kept.append(path + (token,))
            first = kept[0]
            if first:
                n = 0
                for token in first:
                    for tokens in kept:
                        if len(tokens) <= n or tokens[n] != token:
                            break
                    else:
                        n += 1
                        continue
                    break
                if n:
                    out += first[:n]
                    last = first[n - 1]
                    kept = [tokens[n:] for tokens in kept]
            live = kept
        return last, open_, tuple(live)

    def encode(self, data: bytes) -> tuple[int, ...]:
        out: list[int] = []
        state, arcs = 0, self.arcs
        for at, byte in enumerate(data):
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                return self._leave(state, data, at, out)
            emitted, state = arc
            if emitted:
                out += emitted
        out += self.states[state][2][-1]
        return tuple(out)

    def _leave(self, state: int, data: bytes, at: int, out: list[int]) -> tuple[int, ...]:
        before = len(out)
        reached = self._run(self.states[state], data[at : at + 1], out)
        if len(self.states) >= self.max_states:
            self._reset()
        else:
            to = self.number.get(reached)
            if to is None:
                to = self.number[reached] = len(self.states)
                self.states.append(reached)
            self.arcs[state << 8 | data[at]] = (tuple(out[before:]), to)
        reached = self._run(reached, data[at + 1 :], out)
        out += reached[2][-1]
        return tuple(out)


class Pieces(dict):
    """Memo from a piece of text to what ``pack`` makes of its ids.

    When full, it becomes the older half and a new one is begun, so frequent pieces stay.
    """

    def __init__(self, encode, pack, limit: int = 350_000):
        super().__init__()
        self.encode, self.pack, self.limit = encode, pack, limit
        self.older: dict = {}

    def __missing__(self, piece: str):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(piece)
        if value is None:
            value = self.pack(self.encode(piece))
        if len(piece) <= 64:
            self[piece] = value
        return value


class Encoder:
    """Whole texts: each match of the pattern by itself, like the public BPE libraries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.transducer = Transducer(self.vocabulary)
        self.pattern = regex.compile(pattern)

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.vocabulary.ranks.get(data)
        return (whole,) if whole is not None else self.transducer.encode(data)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece, self.pattern.findall(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = Utf8Machine()
        for i in ids:
            text = machine.feed(self.vocabulary.tokens[i])
            if text:
                yield text
        text = machine.close()
        if text:
            yield text


class Utf8Machine:
    """Incremental UTF-8: the state is the unfinished sequence, never over three bytes.

    Malformed bytes become U+FFFD, as ``bytes.decode(errors="replace")`` does.
    """

    def __init__(self):
        self.pending = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a sequence that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            c = data[-back]
            if c & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= c <= 0xDF else 3 if 0xE0 <= c <= 0xEF else 4 if 0xF0 <= c <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(c, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        n = self._unfinished(data)
        self.pending = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


_encoders: dict[tuple, Encoder] = {}


def encoder_of(path: str, pattern: str, load=load_ranks) -> Encoder:
    """One encoder for each Python worker and vocabulary.

    The memos hold millions of small tuples and no cycles, so the cyclic collector, which
    would walk them again and again, is left to rare runs.
    """
    gc.set_threshold(200_000, 50, 1000)
    key = (path, pattern, load.__name__)
    if key not in _encoders:
        _encoders[key] = Encoder(load(path), pattern)
    return _encoders[key]


def encoder(path: str, pattern: str) -> Encoder:
    return encoder_of(path, pattern)
