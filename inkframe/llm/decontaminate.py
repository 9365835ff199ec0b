"""Benchmark decontamination by a generalised suffix automaton of test items.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. The automaton of all items' words is fed
a document's words; the longest matching length after each word tells which windows (size consecutive item words, or a
whole shorter item) end there, and all their words are hit. Before that, vectorised hashes of word pairs find the
stretches in which every pair occurs in an item; only those can hold a window, so only those go through the automaton.

The automaton is broadcast in shards of at most max_words item words, one pass over the documents for each, so nothing
broadcast grows beyond that. Null and empty texts have no words; items without words match nothing; items with a null id
hit words but are not listed; repeated rows give equal results; columns named like an output are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
IS_WORD = np.array([bool(WORD.fullmatch(bytes([b]))) for b in range(256)])
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer texts stream through the automaton alone.
LONG_TEXT = 8_000_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("words", T.LongType())]))
OUTPUTS = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Automaton:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.size = size
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        holds: list[set] = [set()]
        self.whole: dict[int, list[tuple[int, str | None]]] = {}
        ends = []
        for name, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), holds)
                holds[last].add(name)
            if words and len(words) < size:
                ends.append((last, len(words), name))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.len[self.link[s]] >= size:
                holds[self.link[s]] |= holds[s]
        self.holds = [h if n >= size else () for h, n in zip(holds, self.len, strict=True)]
        for s, n, name in ends:
            while self.len[self.link[s]] >= n:
                s = self.link[s]
            self.whole.setdefault(s, []).append((n, name))
        self.marked = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            if s:
                self.marked[s] = s if s in self.whole else self.marked[self.link[s]]

    def _extend(self, last: int, w: int, holds: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q, holds)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        holds.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q, holds)
        return cur

    def _clone(self, p: int, w: int, q: int, holds: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        holds.append(set())
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def hits(self, words: Iterable[bytes], found: set) -> Iterator[tuple[int, int]]:
        """Word ranges that windows cover, by their end; found gets the items."""
        nxt, link, length, size = self.next, self.link, self.len, self.size
        s = n = 0
        for i, word in enumerate(words):
            w = self.ids.get(word)
            if w is None:
                s = n = 0
                continue
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s = nxt[s][w]
                n += 1
            best = 0
            if n >= size:
                best, at = size, s
                while length[link[at]] >= size:
                    at = link[at]
                found.update(self.holds[at])
            m = self.marked[s]
            while m > 0:
                for k, name in self.whole[m]:
                    if k <= n:
                        best = max(best, k)
                        found.add(name)
                m = self.marked[link[m]]
            if best:
                yield i + 1 - best, i + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans, all from one running sum."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Finder:
    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.automaton = Automaton(items, size)
        self.least = min((min(size, len(w)) for _, w in items if w), default=0)
        self.gram = 2 if self.least >= 2 else 1
        self.power = self.inverse = np.empty(0, np.uint64)
        pairs = {b"\0".join(w[i : i + self.gram]) for _, w in items for i in range(len(w) - self.gram + 1)}
        texts = sorted(pairs)
        self.known = np.unique(self._grams(np.frombuffer(b"\0".join(x + b"\0" for x in texts), np.uint8), texts))

    def _tables(self, n: int) -> None:
        if len(self.power) < n:
            self.power = powers(int(BASE), n)
            self.inverse = powers(pow(int(BASE), -1, 2**64), n)

    def _grams(self, buf: np.ndarray, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0, np.uint64)
        starts, ends = self._words(buf)
        h = self._mixed(buf, starts, ends)
        return h[:: self.gram] if self.gram == 1 else self._pairs(h)[::2]

    def _words(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], IS_WORD[buf], [False]]).astype(np.int8)))
        return edge[::2], edge[1::2]

    def _mixed(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._tables(len(buf) + 1)
        return word_hashes(buf, starts, ends, self.power, self.inverse)

    @staticmethod
    def _pairs(h: np.ndarray) -> np.ndarray:
        return h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]

    def find(self, texts: list[str]) -> list[tuple[int, list[dict], list[str]]]:
        raw = [t.encode().lower() for t in texts]
        joined = b"\0\n\0".join(x if len(x) <= LONG_TEXT else b"" for x in raw)
        buf = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(x) if len(x) <= LONG_TEXT else 0 for x in raw])
        begin = np.cumsum(sizes + 3) - sizes - 3
        starts, ends = self._words(buf)
        bounds = np.searchsorted(starts, np.append(begin, len(buf) + 3))
        out = [(int(n), [], []) for n in np.diff(bounds)]
        if self.least and len(starts) >= self.gram:
            grams = self._mixed(buf, starts, ends)
            grams = grams if self.gram == 1 else self._pairs(grams)
            at = np.minimum(np.searchsorted(self.known, grams), max(0, len(self.known) - 1))
            ok = self.known[at] == grams if len(self.known) else np.zeros(len(grams), bool)
            if self.gram == 2:
                inner = bounds[1:-1]
                ok[inner[(inner > 0) & (inner <= len(ok))] - 1] = False  # pairs across two texts
                between = np.empty(0, np.int64)
            else:
                between = bounds[1:-1] + np.arange(len(bounds) - 2)
                ok = np.insert(ok, bounds[1:-1], False)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
            edge = edge - np.searchsorted(between, edge)
            first, last = edge[::2], edge[1::2] + self.gram - 1
            long = last - first >= self.least
            first, last = first[long], last[long]
            doc = np.searchsorted(bounds, first, side="right") - 1
            for d in np.unique(doc):
                found, spans, base = set(), [], int(begin[d])
                for lo, hi in zip(first[doc == d].tolist(), last[doc == d].tolist(), strict=True):
                    words = (joined[starts[i] : ends[i]] for i in range(lo, hi))
                    spans += self._merged((lo + a, lo + b) for a, b in self.automaton.hits(words, found))
                spans = self._merged(spans)
                out[d] = (out[d][0], [{"start": int(starts[a]) - base, "end": int(ends[b - 1]) - base, "words": b - a} for a, b in spans], self._names(found))
        for i, x in enumerate(raw):
            if len(x) > LONG_TEXT:
                out[i] = self._stream(x)
        return out

    @staticmethod
    def _names(found: set) -> list[str]:
        return sorted(x for x in found if x is not None)

    @staticmethod
    def _merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ranges that touch or overlap become one; they come in order of their ends."""
        out: list[tuple[int, int]] = []
        for a, b in ranges:
            while out and out[-1][1] >= a:
                a = min(a, out.pop()[0])
            out.append((a, b))
        return out

    def _stream(self, raw: bytes) -> tuple[int, list[dict], list[str]]:
        """The same for one long text, without any array of its length."""
        found, n, recent, spans = set(), 0, [], []

        def words():
            nonlocal n
            for m in WORD.finditer(raw):
                n += 1
                recent.append(m.span())
                if len(recent) > 4 * self.automaton.size:
                    del recent[: -2 * self.automaton.size]
                yield m[0]

        for a, b in self.automaton.hits(words(), found):
            lo, hi, count = recent[a - n][0], recent[b - n - 1][1], (a, b)
            while spans and spans[-1][2][1] >= count[0]:
                old = spans.pop()
                lo, count = min(lo, old[0]), (min(count[0], old[2][0]), b)
            spans.append((lo, hi, count))
        return n, [{"start": lo, "end": hi, "words": c[1] - c[0]} for lo, hi, c in spans], self._names(found)


def shards(items: DataFrame, max_words: int, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items' words in lists of at most max_words words (or one longer item); one is held at a time."""
    some, n = [], 0
    for r in items.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        words = words_of(r[1] or "")
        if some and n + len(words) > max_words:
            yield some
            some, n = [], 0
        if words:
            some.append((r[0], words))
            n += len(words)
    if some:
        yield some


_made: dict[str, Finder] = {}


def find_hits(df: DataFrame, items: DataFrame, size: int = 10, max_words: int = 200_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds n_words, spans (byte ranges of hit words in the text's UTF-8, with their words) and items (ids with windows)."""
    sc = df.sparkSession.sparkContext
    out = None
    for some in shards(items, max_words, item_id, item_text):
        shared = sc.broadcast(some)

        def make(shared=shared, key=uuid.uuid4().hex):
            finder = _made.get(key)
            if finder is None:
                _made.clear()
                finder = _made[key] = Finder(shared.value, size)

            def work(texts: list[str]) -> list[list]:
                return [list(x) for x in zip(*finder.find(texts), strict=True)]

            return work

        if out is None:
            out = map_text(df, text_col, OUTPUTS, make)
        else:
            before = out.withColumnsRenamed({"spans": "_spans_before", "items": "_items_before"})
            more = map_text(before, text_col, OUTPUTS, make)
            out = _both(more, text_col)
    if out is None:
        out = map_text(df, text_col, OUTPUTS, lambda: lambda texts: [[len(words_of(t)) for t in texts], [[] for _ in texts], [[] for _ in texts]])
    return out


def _both(df: DataFrame, text_col: str) -> DataFrame:
    """Spans of two shards as one list of disjoint spans, their words counted anew."""
    both = F.array_sort(F.concat("_spans_before", "spans"))
    span = lambda lo, hi: F.struct(lo.alias("start"), hi.alias("end"), F.lit(0).cast("long").alias("words"))
    none = F.lit(None).cast(SPANS)

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last["start"], F.greatest(last["end"], x["end"]))))
        return F.when((F.size(acc) > 0) & (last["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(span(x["start"], x["end"]))))

    merged = F.aggregate(both, F.coalesce(none, F.slice(both, 1, 0)), add)
    counted = F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_count(_part(text_col, s["start"], s["end"]), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("words")))
    return df.withColumns({"spans": counted, "items": F.array_sort(F.array_union("_items_before", "items"))}).drop("_spans_before", "_items_before")


def _part(text_col: str, start: Column, end: Column) -> Column:
    """A byte range of a text's UTF-8."""
    raw = F.encode(F.col(text_col), "utf-8")
    return F.decode(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")), "utf-8")


def clean(df: DataFrame, items: DataFrame, size: int = 10, max_coverage: float = 0.8, text_col: str = "text", **more) -> DataFrame:
    """Documents without their hit spans; those hit in more than max_coverage of their words go."""
    found = find_hits(df, items, size, text_col=text_col, **more)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    kept = found.where((F.size("spans") == 0) | (n_hit <= F.col("n_words") * max_coverage))
    cuts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    till = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length(text_col).cast("long")))
    parts = F.zip_with(cuts, till, lambda a, b: _part(text_col, a, b))
    return kept.withColumn(text_col, F.when(F.size("spans") == 0, F.col(text_col)).otherwise(F.array_join(parts, "")))
