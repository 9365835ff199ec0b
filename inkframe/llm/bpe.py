"""Byte-level BPE over distinct pieces in padded numpy matrices, with a round trip back to bytes.

Each task cuts texts by the pattern, gathers the pieces it hasn't met, and encodes them by length bucket: a matrix
holds one piece a row, and each round merges every row's leftmost pair of least rank; finished rows leave the matrix.
Nothing is shuffled. Null and empty texts give no ids; repeated rows give equal ids; an empty table gives no rows;
columns named like an output are replaced.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

NONE = np.int32(2**31 - 1)
OUTPUTS = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
#: Longer pieces are merged alone, from a heap in place of a full row scan for each merge.
LONG_PIECE = 192
LONG_TEXT = 1_000_000
MAX_CACHE = 400_000


class PairTable:
    """Pairs of ids to a value, by open addressing; many keys are looked up at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.values[slot[todo]] == NONE
            won = todo[free]
            _, first = np.unique(slot[won], return_index=True)
            won = won[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], value[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def as_dict(self) -> dict[int, int]:
        """The same for one key at a time: left id in the upper 32 bits, right id in the lower."""
        held = self.values != NONE
        return dict(zip(self.keys[held].tolist(), self.values[held].tolist(), strict=True))

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Values, NONE where absent. A negative id pairs with nothing."""
        shape = left.shape
        l, r = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        out = np.full(l.shape, NONE, np.int32)
        todo = np.flatnonzero((l >= 0) & (r >= 0))
        keys = (l[todo].astype(np.uint64) << np.uint64(32)) | r[todo].astype(np.uint64)
        slot = self._slot(keys)
        for _ in range(self.probes):
            if not len(todo):
                break
            hit = self.keys[slot] == keys
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (self.values[slot] != NONE)
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & self.mask
        return out.reshape(shape)


class Bpe:
    def __init__(self, tokens: list[bytes], pattern: str):
        """tokens: byte strings in order of rank; every single byte must be among them."""
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a = np.array(pairs, np.int64).reshape(-1, 3)
        self.pairs = PairTable(a[:, 0], a[:, 1], a[:, 2].astype(np.int32))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.cache: dict[str, bytes] = {}
        self.rank_of: dict[int, int] | None = None

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces are merged by length bucket."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = np.array([self.ranks[p]], np.int32)
            elif len(p) > LONG_PIECE:
                out[i] = self._merge_long(self.byte_ids[np.frombuffer(p, np.uint8)])
            else:
                buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, 2_000_000 // width)
            for lo in range(0, len(rows), step):
                self._merge_bucket(pieces, rows[lo : lo + step], width, out)
        return out

    def _merge_bucket(self, pieces: list[bytes], rows: list[int], width: int, out: list[np.ndarray]) -> None:
        n = np.array([len(pieces[i]) for i in rows])
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        col = np.arange(width)
        ids = np.where(col < n[:, None], self.byte_ids[raw], -1)
        left = np.array(rows)
        rank = np.full((len(rows), width), NONE, np.int32)
        rank[:, :-1] = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(left):
            at = rank.argmin(1)
            row = np.arange(len(left))
            best = rank[row, at]
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[left[r]] = ids[r, : n[r]]
                keep = ~done
                left, ids, rank, n, at, best = left[keep], ids[keep], rank[keep], n[keep], at[keep], best[keep]
                row = np.arange(len(left))
                if not len(left):
                    break
                width = int(n.max())
                ids, rank, col = ids[:, :width], rank[:, :width], col[:width]
            after = np.minimum(col + (col > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, after, 1)
            rank = np.take_along_axis(rank, after, 1)
            n = n - 1
            ids[row, n], rank[row, n] = -1, NONE
            ids[row, at] = best
            nxt = np.where(at + 1 < n, ids[row, np.minimum(at + 1, width - 1)], -1)
            rank[row, at] = self.pairs.get(best, nxt)
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.pairs.get(ids[has, at[has] - 1], best[has])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges for one long piece: neighbours are linked, and pairs wait in a heap by rank, then place."""
        if self.rank_of is None:
            self.rank_of = self.pairs.as_dict()
        n, of = len(ids), self.rank_of
        rank = self.pairs.get(ids[:-1], ids[1:])
        at = np.flatnonzero(rank != NONE)
        # one number holds rank and place; entries whose pair has since changed are passed over
        heap = ((rank[at].astype(np.int64) << 32) | at).tolist()
        heapify(heap)
        known = array("i", np.append(rank, NONE).astype(np.int32).tobytes())
        token, nxt, prev = array("i", ids.astype(np.int32).tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        none = int(NONE)
        while heap:
            r, i = divmod(heappop(heap), 1 << 32)
            if known[i] != r:
                continue
            j = nxt[i]
            token[i], token[j], known[j] = r, -1, none
            k = nxt[i] = nxt[j]
            known[i] = none
            if k < n:
                prev[k] = i
                known[i] = new = of.get((r << 32) | token[k], none)
                if new != none:
                    heappush(heap, (new << 32) | i)
            if (p := prev[i]) >= 0:
                known[p] = new = of.get((token[p] << 32) | r, none)
                if new != none:
                    heappush(heap, (new << 32) | p)
        out = np.frombuffer(token, np.int32)
        return out[out >= 0]

    def _ids(self, pieces: list[list[str]]) -> list[bytes]:
        cache = self.cache
        if len(cache) > MAX_CACHE:
            cache.clear()
        new = list({p for some in pieces for p in some}.difference(cache))
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            cache[p] = ids.astype("<u4").tobytes()
        return [b"".join(map(cache.__getitem__, some)) for some in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        short = [t if len(t) <= LONG_TEXT else "" for t in texts]
        out = self._ids([self.pattern.findall(t) for t in short])
        for i, t in enumerate(texts):
            if len(t) > LONG_TEXT:
                found, parts = (m[0] for m in self.pattern.finditer(t)), []
                while some := list(islice(found, 200_000)):
                    parts += self._ids([some])
                out[i] = b"".join(parts)
        return out

    def decode(self, ids: bytes) -> bytes:
        a = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for lo in range(0, len(a), 1_000_000):
            part = a[lo : lo + 1_000_000]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def load_tokens(path: str) -> list[bytes]:
    """The byte strings of a ranks file (base64 and rank a line), in order of rank. Read on the driver only."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


_made: dict[tuple, Bpe] = {}


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, token_ids (little-endian unsigned 32-bit) and decoded (bytes made from the ids alone).

    The vocabulary is a file of fixed size; the driver reads it and broadcasts its tokens.
    """
    tokens = load_tokens(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    key = (vocabulary, pattern)

    def make():
        if key not in _made:
            _made[key] = Bpe(shared.value, pattern)
        bpe = _made[key]

        def work(texts: list[str]) -> list[list]:
            ids = bpe.encode(texts)
            return [[len(x) // 4 for x in ids], ids, [bpe.decode(x) for x in ids]]

        return work

    return map_text(df, text_col, OUTPUTS, make)
