"""Byte-level BPE by a transducer: encoding with bounded lookahead, streaming decoding.

A sequence of tokens is what the merges give for its bytes exactly when every two neighbours are, so whether a token may
follow another depends on these two alone. That makes encoding regular. A hypothesis is (tokens so far, place in the
trie of the vocabulary); the transducer's state is the set of live hypotheses with their common beginning cut off, and a
token is emitted as soon as all of them agree on it. A hypothesis dies when its bytes start no token, so a token waits
for no more bytes than the longest token has. States and transitions are made when first met, up to a bound; from a state
on that has no transition yet, once the table is full, the same hypotheses are followed without making states.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ._shared import whole_text
from ._tokens import BYTE_LEVEL, PieceEncoder


class BpeTransducer:
    """Encodes byte strings by ranked merges. ranks: token bytes -> id, where the lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = 100_000, max_pairs: int = 500_000):
        self.ranks, self.max_transitions, self.max_pairs = ranks, max_transitions, max_pairs
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        token_at: dict[int, int] = {}
        nodes = 1
        for token, i in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            token_at[node] = i
        self.token_at = [token_at.get(n, -1) for n in range(nodes)]
        self.inner = bytearray(nodes)  # nodes with children
        for key in self.child:
            self.inner[key >> 8] = 1
        self.pairs: dict[tuple[int, int], bool] = {}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte -> (state, emitted)
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ends: list[tuple[int, ...] | None] = []
        self.start = self._state((-1, (((), 0),)))

    def _state(self, key: tuple) -> int:
        s = self.ids.get(key)
        if s is None:
            s = self.ids[key] = len(self.states)
            self.states.append(key)
            self.ends.append(next((outs for outs, node in key[1] if node == 0), None))
        return s

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, on a short byte string: the lowest rank first, leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b can stand right after a (-1: at the start)."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            ok = self.merged(self.bytes_of[b]) == [b] if a < 0 else self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.pairs[a, b] = ok
        return ok

    def _next(self, before: int, live: tuple, byte: int) -> list[tuple]:
        """The hypotheses after one more byte."""
        moved = []
        child, token_at, inner, pairs = self.child.get, self.token_at, self.inner, self.pairs
        for outs, node in live:
            node = child(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                moved.append((outs, node))
            t = token_at[node]
            if t >= 0:
                last = outs[-1] if outs else before
                ok = pairs.get((last, t))
                if self.may_follow(last, t) if ok is None else ok:
                    moved.append(((*outs, t), 0))
        return moved

    @staticmethod
    def _agreed(before: int, moved: list[tuple]) -> tuple[tuple[int, ...], tuple]:
        """The tokens that all hypotheses begin with, and (last token before, hypotheses) without them."""
        common = 0
        first = moved[0][0]
        while common < len(first) and all(len(o) > common and o[common] == first[common] for o, _ in moved):
            common += 1
        out = first[:common]
        return out, (out[-1] if out else before, tuple((o[common:], n) for o, n in moved))

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        out, key = self._agreed(self.states[state][0], self._next(*self.states[state], byte))
        return self._state(key), out

    def _simulated(self, state: int, data: bytes) -> list[int]:
        """What the rest of the bytes emits, from a state on, without making further states."""
        done: list[int] = []
        before, live = self.states[state]
        for b in data:
            live = self._next(before, live, b)
            if len(live[0][0]) > 8:
                out, (before, live) = self._agreed(before, live)
                done += out
        return done + list(next(outs for outs, node in live if node == 0))

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the splitting pattern."""
        s, out, step = self.start, [], self.step
        for at, b in enumerate(data):
            key = s << 8 | b
            to = step.get(key)
            if to is None:
                if len(step) >= self.max_transitions:
                    return out + self._simulated(s, data[at:])
                to = step[key] = self._move(s, b)
            s, emitted = to
            if emitted:
                out += emitted
        return out + list(self.ends[s] or ())


class Utf8Stream:
    """Incremental UTF-8: bytes in any portions, text out as soon as a character is whole.

    The state is the unfinished bytes of one character, three at most. Malformed bytes become U+FFFD.
    """

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end belong to a character that may go on."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 4 if 0xF0 <= b <= 0xF4 else 3 if b & 0xF0 == 0xE0 else 2 if 0xC2 <= b <= 0xDF else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data) - self._unfinished(data)
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder of whole texts for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.fst = BpeTransducer(self.ranks)
        if pattern != BYTE_LEVEL:
            raise ValueError("texts are cut at spaces, which is proved for the one pattern BYTE_LEVEL alone")
        one = self.fst.encode
        self.pieces = PieceEncoder(lambda match: one(match.encode()), True, np.uint16 if len(self.ranks) <= 1 << 16 else np.uint32)
        top = max(self.ranks.values()) + 1
        self.names = [str(i) for i in range(top)]
        self.parts = [self.fst.bytes_of.get(i, b"") for i in range(top)]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for packed in self.pieces.encode(texts):
            yield np.frombuffer(packed, self.pieces.dtype)

    def decode(self, ids: np.ndarray, portion: int = 1 << 16) -> Iterator[str]:
        """The text in portions, whole characters each."""
        stream, part = Utf8Stream(), self.parts.__getitem__
        for at in range(0, len(ids), portion):
            yield stream.feed(b"".join(map(part, ids[at : at + portion].tolist())))
        yield stream.close()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text as an array; a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [x.astype(np.int32) for x in c.encode(b["text"])]})

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), whole_text(text_col).alias("text"))
    return picked.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": ["".join(c.decode(np.asarray(x, np.int64))) for x in b["ids"]]})

    kind = encoded.schema[id_col].dataType.simpleString()
    picked = encoded.select(encoded[id_col].alias("id"), "ids")
    return picked.mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again in one pass.

    Null and empty texts: 0 tokens and the digests of nothing. Repeated rows give repeated results. Only doc_id and text
    are read, whatever else the table holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        name = c.names.__getitem__
        for b in batches:
            n, shas, decoded = [], [], []
            for ids in c.encode(b["text"]):
                whole = hashlib.sha256()
                for text in c.decode(ids):
                    whole.update(text.encode())
                n.append(len(ids))
                shas.append(hashlib.sha256(",".join(map(name, ids.tolist())).encode()).hexdigest())
                decoded.append(whole.hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": shas, "decoded_sha256": decoded})

    picked = docs.select("doc_id", whole_text().alias("text"))
    return picked.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
