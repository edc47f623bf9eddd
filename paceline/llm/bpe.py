"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a stream.

Encoding. The last token of a prefix's encoding is unique: it is the token t that ends there, starts at a boundary
whose own last token u makes (u, t) a valid pair (merging u + t by rank gives u, t again). So one pass over the bytes
of a piece finds for each position its last token. The transducer does that pass once per distinct situation: a state
is the last emitted token and the bytes since; reading a byte adds a position, and the tokens on which all positions
agree at which a token may still start are emitted. A position can be a start only while the bytes behind it begin
some token, so lookahead is bounded by the longest token. States and arrows are made when first met and dropped
together when there are max_states of them; results of short pieces are kept the same way.

A piece that is a token itself is that token, as the ranks define. Pieces are the matches of a pattern, each
encoded separately.

Decoding. Utf8Stream takes bytes in any cuts and gives text up to the last whole character: a small state machine
over the last three bytes tells how many bytes of an unfinished character to hold back.

Defined cases: null texts encode as empty; ids are little-endian unsigned 32-bit integers in a binary column; null
ids decode to empty text; unknown ids raise KeyError; ids that don't form UTF-8 decode with U+FFFD; columns named
like the added ones are replaced; empty tables, ties and repeated rows need no care, as rows are independent.
"""

from __future__ import annotations

import array
import base64
import gc
import hashlib
import sys
from pathlib import Path

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.shared import aside, restored, with_python


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of a base64 token, a blank and its rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, Path(path).read_bytes().splitlines())}


#: What a token may still grow from: the trie's node, the token before it, the tokens since the last emitted one.
Live = tuple[int, int, tuple[int, ...]]
START = -1
MISSING = ()


class State:
    """last and pending name the state; live: the positions at which a token may still start, the current one, whose
    tokens are all that is pending, at the end."""

    __slots__ = ("arrows", "last", "live", "pending")

    def __init__(self, last: int, pending: bytes, live: list[Live]):
        self.last, self.pending, self.live = last, pending, live
        self.arrows: dict[int, tuple[State, tuple[int, ...]]] = {}


class Transducer:
    """Bytes of one piece in, ids out; see the module's docstring."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.trie: dict[int, int] = {}  # node << 8 | byte -> node
        self.token_at: list[int | None] = [None]
        self.inner = bytearray(1)  # whether a node goes on
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                key = node << 8 | byte
                node = self.trie.get(key)
                if node is None:
                    node = self.trie[key] = len(self.token_at)
                    self.token_at.append(None)
                    self.inner.append(0)
            self.token_at[node] = i
        self.halves: dict[int, tuple[int, int]] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple[int, bytes], State] = {}
        self.reset()

    def reset(self) -> None:
        for state in self.states.values():
            state.arrows.clear()  # states refer to each other
        self.start = State(START, b"", [(0, START, ())])
        self.states = {(START, b""): self.start}

    def split(self, i: int) -> tuple[int, int]:
        """The two tokens whose merge made this one: what merging by lower ranks leaves of its bytes."""
        found = self.halves.get(i)
        if found is None:
            token = self.bytes_of[i]
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[k] + parts[k + 1], i), k) for k in range(len(parts) - 1))
                if rank == i:
                    raise ValueError(f"no two tokens make {token!r}")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.halves[i] = self.ranks[parts[0]], self.ranks[parts[1]]
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left in an encoding; anything may follow START.

        While left and right were being merged, their parts a | b at the border changed in the order of the ranks.
        The border would have been merged away if a + b is a token of a lower rank than what a and b went into; at
        equal ranks the leftmost merge comes first.
        """
        if left == START:
            return True
        found = self.valid.get((left, right))
        if found is None:
            ranks, text, a, b = self.ranks, self.bytes_of, left, right
            into_a = into_b = sys.maxsize
            while True:
                rank = ranks.get(text[a] + text[b], sys.maxsize)
                if rank < into_a and rank <= into_b and rank < sys.maxsize:
                    found = False
                    break
                one_a, one_b = len(text[a]) == 1, len(text[b]) == 1
                if one_a and one_b:
                    found = True
                    break
                # one merge back: of the two border tokens, the one that was made later
                if one_b or (not one_a and a > b):
                    into_a, a = a, self.split(a)[1]
                else:
                    into_b, b = b, self.split(b)[0]
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            self.valid[left, right] = found
        return found

    def read(self, live: list[Live], data: bytes) -> list[Live]:
        """What the bytes of data make of the live positions, nothing being emitted."""
        trie, token_at, inner, valid = self.trie, self.token_at, self.inner, self.valid
        for byte in data:
            then: list[Live] = []
            own: Live | None = None
            for node, before, way in live:
                node = trie.get(node << 8 | byte)
                if node is None:
                    continue
                if own is None:
                    token = token_at[node]
                    if token is not None:
                        fits = valid.get((before, token))
                        if self.fits(before, token) if fits is None else fits:
                            own = 0, token, (*way, token)
                if inner[node]:
                    then.append((node, before, way))
            then.append(own)
            live = then
        return live

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Make the state's arrow for the byte."""
        live = self.read(state.live, bytes((byte,)))
        pending, last, emitted = state.pending + bytes((byte,)), state.last, ()
        first = live[0][2]
        if first and all(x[2][:1] == first[:1] for x in live):  # all ways that are left begin with the same tokens
            n = 1
            while n < len(first) and all(x[2][n : n + 1] == first[n : n + 1] for x in live):
                n += 1
            emitted, last = first[:n], first[n - 1]
            live = [(node, before, way[n:]) for node, before, way in live]
            pending = pending[sum(len(self.bytes_of[i]) for i in emitted) :]
        nxt = self.states.get((last, pending))
        if nxt is None:
            if len(self.states) >= self.max_states:
                self.reset()
            nxt = self.states[last, pending] = State(last, pending, live)
        state.arrows[byte] = nxt, emitted
        return nxt, emitted

    def encode(self, piece: bytes) -> list[int]:
        """An arrow is made when it is wanted a second time: the first time the rest of a short piece is read without."""
        state, out = self.start, []
        for k, byte in enumerate(piece):
            arrow = state.arrows.get(byte, MISSING)
            if arrow is MISSING and len(piece) - k <= 24:
                state.arrows[byte] = None
                out += self.read(state.live, piece[k:])[-1][2]
                return out
            state, emitted = (arrow if arrow else self.step(state, byte))
            if emitted:
                out += emitted
        out += state.live[-1][2]
        return out


class Pieces(dict):
    """Piece to the packed ids of its tokens, filled by the transducer."""

    def __init__(self, transducer: Transducer, most: int = 300_000):
        super().__init__()
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        data, ranks = piece.encode(), self.transducer.ranks
        ids = array.array("I", [ranks[data]] if data in ranks else self.transducer.encode(data))
        if sys.byteorder == "big":
            ids.byteswap()
        packed = ids.tobytes()
        if len(data) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


class Utf8Stream:
    """Incremental UTF-8 decoding: feed() gives all whole characters, end() what is left."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't whole."""
        for n in range(1, min(3, len(data)) + 1):
            byte = data[-n]
            if byte >= 0xC0:
                return n if n < 2 + (byte >= 0xE0) + (byte >= 0xF0) else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.unfinished(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = Pieces(Transducer(ranks))
        self.find = regex.compile(pattern).findall
        self.bytes_of = self.pieces.transducer.bytes_of

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, packed: bytes, n: int = 65_536) -> str:
        """The text of packed ids, n tokens at a time."""
        stream, out = Utf8Stream(), []
        ids = array.array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        for at in range(0, len(ids), n):
            out.append(stream.feed(b"".join(map(self.bytes_of.__getitem__, ids[at : at + n]))))
        out.append(stream.end())
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str, name: str) -> Codec:
    """One codec per worker process, kept from task to task."""
    if name not in _codecs:
        _codecs.clear()
        gc.set_threshold(1_000_000, 50, 50)  # states are many small objects that stay; looking at them often is slow
        _codecs[name] = Codec(ranks, pattern)
    return _codecs[name]


def _shared(df: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)
    name = hashlib.sha256(pattern.encode() + Path(path).read_bytes()).hexdigest()
    return df.sparkSession.sparkContext.broadcast(ranks), name  # as large as the vocabulary file, whatever the data


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """The rows of docs with ids (packed, see above) and n_tokens."""
    held, names = aside(docs)
    ranks, name = _shared(docs, path, pattern)

    def start():
        found = codec(ranks.value, pattern, name)
        return lambda texts: [[found.encode(t or "") for t in texts]]

    out = with_python(held, [names[text]], "ids binary", start)
    return restored(out, names, ids=F.col("ids"), n_tokens=F.floor(F.octet_length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """The rows with decoded, the text of their ids."""
    held, names = aside(encoded)
    ranks, name = _shared(encoded, path, pattern)

    def start():
        found = codec(ranks.value, pattern, name)
        return lambda packed: [[found.decode(x or b"") for x in packed]]

    return restored(with_python(held, [names[ids]], "decoded string", start), names, decoded=F.col("decoded"))


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """The rows of docs with ids, n_tokens and decoded: decode(encode(docs)) with one codec for both in each task.

    Two steps in one plan are two workers for each task, each with the vocabulary and what it has learned.
    """
    held, names = aside(docs)
    ranks, name = _shared(docs, path, pattern)

    def start():
        found = codec(ranks.value, pattern, name)

        def work(texts: list) -> list:
            packed = [found.encode(t or "") for t in texts]
            return [packed, [found.decode(x) for x in packed]]

        return work

    out = with_python(held, [names[text]], "ids binary, decoded string", start)
    return restored(out, names, ids=F.col("ids"), n_tokens=F.floor(F.octet_length("ids") / 4).cast("long"), decoded=F.col("decoded"))
