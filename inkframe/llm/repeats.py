"""Removal of repeated byte strings by a prefix-free parse.

A rolling hash of gram bytes is taken at every byte; a position is a trigger if its hash is least among the
length - gram + 1 grams of some string of the given length. So every such string holds a trigger at a place that depends
on its bytes alone, and equal strings share the triggers. A trigger with the bytes up to length - gram before and behind
its gram is a phrase. The dictionary of distinct phrases, by trigger gram, stands for the corpus: only phrases with the
same gram can share a string, and phrases that occur twice are covered whole. What is left of the dictionary is compared
inside its grams: how far two phrases agree to the left and to the right of the gram (their common prefixes in corpus
order and in reverse) gives the shared strings, and the widest of them what to remove.

Grams with many distinct phrases are not compared pair by pair: each phrase puts out hashes of coarse stretches, then,
if any is shared, of its strings, and shared hashes are found by counting. So no task holds an unbounded group.

Null and empty texts, and those under the length, keep all bytes; repeated rows count as repeats of each other; an empty
table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, spread_join, without
from .decontaminate import powers

BASE = 0x9E3779B97F4A7C15
GRAM = 100
#: Distinct phrases of one gram that are compared pair by pair.
MAX_PAIRED = 256
STEP = 17
PIECE = 4_000_000
OUTPUTS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]


def row_key(id_col: str, text_col: str) -> Column:
    """Equal only for rows with equal id and text, which get equal results."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.length(F.col(text_col)))


def _slide(a: np.ndarray, n: int, least) -> np.ndarray:
    """least over each n neighbours."""
    width = 1
    while 2 * width <= n:
        a = least(a[:-width], a[width:])
        width *= 2
    return least(a[: len(a) - (n - width)], a[n - width :]) if n > width else a


class Parser:
    """Triggers and phrase hashes of texts."""

    def __init__(self, length: int):
        self.length, self.side = length, length - GRAM
        self.power = self.inverse = np.empty(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.power) < n:
            self.power, self.inverse = powers(BASE, n), powers(pow(BASE, -1, 2**64), n)

    def triggers(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets in buf, gram hashes and phrase hashes, for texts that lie at [begin, end) in buf."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(buf) < self.length:
            return none
        self._tables(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[: len(buf)], out=total[1:])
        grams = (total[GRAM:] - total[:-GRAM]) * self.inverse[: len(buf) - GRAM + 1]
        order = _mix(grams)
        grams = order.view(np.int64)
        # 0 is kept for places outside of strings
        order = np.maximum((order >> np.uint64(32)).astype(np.uint32), 1)
        n = self.side + 1
        least = _slide(order, n, np.minimum)
        starts_in = np.zeros(len(buf) + 1, np.int32)
        whole = end - begin >= self.length
        np.add.at(starts_in, begin[whole], 1)
        np.add.at(starts_in, end[whole] - self.length + 1, -1)
        inside = np.cumsum(starts_in)[: len(least)] > 0
        # a gram is a trigger if it equals the minimum of some string that holds it: of all those, the greatest minimum
        padded = np.concatenate([np.zeros(n - 1, np.uint32), np.where(inside, least, 0), np.zeros(n - 1, np.uint32)])
        at = np.flatnonzero(_slide(padded, n, np.maximum) == order)
        if not len(at):
            return none
        doc = np.searchsorted(begin, at, side="right") - 1
        lo, hi = np.maximum(begin[doc], at - self.side), np.minimum(end[doc], at + self.length)
        phrase = _mix((total[hi] - total[lo]) * self.inverse[lo] + (at - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (hi - at).astype(np.uint64))
        return at, grams[at], phrase.view(np.int64)

    def of(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, offset, gram hash and phrase hash of each trigger."""
        sizes = np.array([len(x) if len(x) <= PIECE else 0 for x in raws], np.int64)
        begin = np.cumsum(sizes) - sizes
        at, gram, phrase = self.triggers(np.frombuffer(b"".join(x for x in raws if len(x) <= PIECE), np.uint8), begin[sizes > 0], (begin + sizes)[sizes > 0])
        row = np.searchsorted(begin, at, side="right") - 1
        out = [(row, at - begin[row], gram, phrase)]
        for i, x in enumerate(raws):
            if len(x) > PIECE:
                out.append(self._long(i, x))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _long(self, row: int, raw: bytes) -> tuple[np.ndarray, ...]:
        """One long text in pieces that overlap enough for every string and phrase."""
        parts = []
        for lo in range(0, max(1, len(raw) - self.length + 1), PIECE):
            a, b = max(0, lo - 2 * self.length), min(len(raw), lo + PIECE + 3 * self.length)
            piece = np.frombuffer(raw[a:b], np.uint8)
            at, gram, phrase = self.triggers(piece, np.array([0]), np.array([len(piece)]))
            # near a cut the phrase is clipped and the strings are not all there: the neighbour piece has those triggers
            good = ((at >= self.length) | (a == 0)) & ((at <= len(piece) - 2 * self.length) | (b == len(raw)))
            parts.append(np.stack([at[good] + a, gram[good], phrase[good]]))
        all_ = np.concatenate(parts, axis=1)
        _, first = np.unique(all_[0], return_index=True)
        return np.full(len(first), row), all_[0][first], all_[1][first], all_[2][first]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _batch(columns: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def parse(df: DataFrame, length: int) -> DataFrame:
    """(key, at, gram, phrase) of every trigger. df has key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length)
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, hi in chunks(b.column(1), 1_000_000):
                raws = [(x or "").encode() for x in b.column(1).slice(lo, hi - lo).to_pylist()]
                row, at, gram, phrase = parser.of(raws)
                yield _batch([keys[lo:hi][row], at, gram, phrase], [pa.int64(), pa.int32(), pa.int64(), pa.int64()], ["key", "at", "gram", "phrase"])

    return df.select("key", "text").mapInArrow(run, "key long, at int, gram long, phrase long")


def _phrases(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of phrases, as left and right of the gram. wanted has key, at, gram, n and members."""
    side = length - GRAM
    lists = wanted.groupBy("key").agg(F.collect_set(F.struct("at", "gram", "n", "members")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "at", "gram", "n", "members", "left", "right"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            out = []
            for key, text, marks in zip(*(b.column(i) for i in range(3)), strict=True):
                raw, key = text.as_py().encode(), key.as_py()
                for m in marks.as_py():
                    a = m["at"]
                    out.append((key, a, m["gram"], m["n"], m["members"], raw[max(0, a - side) : a], raw[a + GRAM : a + length]))
                if len(out) > 5000:
                    yield _batch(list(zip(*out, strict=True)), types, names)
                    out = []
            if out:
                yield _batch(list(zip(*out, strict=True)), types, names)

    return docs.join(lists, "key").select("key", "text", "marks").mapInArrow(run, "key long, at int, gram long, n long, members long, left binary, right binary")


def _agree(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Bytes of the common prefix of rows of 8-byte words, within both lengths."""
    x = a ^ b
    at = (x != 0).argmax(1)
    word = x[np.arange(len(x)), at]
    low = word & (~word + np.uint64(1))
    inside = np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3
    return np.minimum(np.where(word == 0, 8 * a.shape[1], 8 * at + inside), np.minimum(na, nb))


def _words(parts: list[bytes], side: int) -> np.ndarray:
    width = -(-side // 8) * 8
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), "<u8").reshape(len(parts), width // 8)


def widest(gram: np.ndarray, left: list[bytes], right: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by gram: how far shared strings reach left and right of the gram; -1 where none is shared."""
    n = len(gram)
    a, b = _words([x[::-1] for x in left], side), _words(right, side)
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    reach_l, reach_r = np.full(n, -1), np.full(n, -1)
    i = np.arange(n)
    for d in range(1, n):
        i = i[i < n - d]
        i = i[gram[i] == gram[i + d]]
        if not len(i):
            break
        q = i + d
        l = _agree(a[i], a[q], na[i], na[q])
        r = _agree(b[i], b[q], nb[i], nb[q])
        ok = l + r >= side
        for x in (i[ok], q[ok]):
            np.maximum.at(reach_l, x, l[ok])
            np.maximum.at(reach_r, x, r[ok])
    return reach_l, reach_r


def _compared(phrases: DataFrame, length: int) -> DataFrame:
    """(key, at, l, r): reaches of phrases that occur once, by pairs inside each gram's few phrases."""
    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            l, r = widest(t["gram"].to_numpy(), t["left"].to_pylist(), t["right"].to_pylist(), side)
            out = np.flatnonzero((l >= 0) & (t["n"].to_numpy() == 1))
            return _batch([t["key"].to_numpy()[out], t["at"].to_numpy()[out], l[out], r[out]], [pa.int64(), pa.int32(), pa.int32(), pa.int32()], ["key", "at", "l", "r"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            if t.num_rows >= 4000:
                gram = t["gram"].to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
                if cut:
                    yield done(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    few = phrases.where(F.col("members") <= MAX_PAIRED)
    return few.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "key long, at int, l int, r int")


def _hashed(df: DataFrame, length: int, coarse: bool) -> DataFrame:
    """(key, at, n, t, h): hashes of a phrase's strings by how far left of the gram they start.

    Coarse ones are shorter stretches: two phrases that share a string which starts t bytes left of the gram share the
    stretch of t rounded down to STEP. Fine ones are the strings of those t whose stretches are in df's column cells.
    """
    side = length - GRAM
    columns = ["key", "at", "gram", "n", "left", "right"] + ["cells"] * (not coarse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out = []
            for key, at, gram, n, left, right, *cells in zip(*(b.column(i).to_pylist() for i in range(len(columns))), strict=True):
                starts = range(0, len(left) + 1, STEP) if coarse else (t for c in cells[0] for t in range(c, min(c + STEP, len(left) + 1)))
                for t in starts:
                    r = max(0, side - t - (STEP - 1)) if coarse else side - t
                    if 0 <= r <= len(right):
                        h = xxhash.xxh64_intdigest(b"%d %d " % (gram, t) + left[len(left) - t :] + right[:r])
                        out.append((key, at, n, t, h - (1 << 63)))
                if len(out) > 50_000:
                    yield _batch(list(zip(*out, strict=True)), types, names)
                    out = []
            if out:
                yield _batch(list(zip(*out, strict=True)), types, names)

    names, types = ["key", "at", "n", "t", "h"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    return df.select(*columns).mapInArrow(run, "key long, at int, n long, t int, h long")


def _shared(hashed: DataFrame) -> DataFrame:
    return hashed.join(hashed.groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") > 1).select("h"), "h")


def _counted(crowd: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """The same as _compared for grams with many phrases, by counting hashes."""
    side = length - GRAM
    rough = _shared(_hashed(crowd, length, True)).groupBy("key", "at").agg(F.collect_set("t").alias("cells"))
    some = crowd.join(rough, ["key", "at"])
    strings = _shared(scratch.cut(_hashed(some, length, False))).where(F.col("n") == 1)
    return strings.groupBy("key", "at").agg(F.max("t").cast("int").alias("l"), (side - F.min("t")).cast("int").alias("r"))


def covers(df: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(key, marks): byte ranges (lo, hi) that together are all repeated strings. df has key and text.

    Ranges whose grams begin less than a gram apart touch, so those of a cell are one: a text that is one long run, with a
    trigger at each byte, still has no more ranges than cells.
    """
    side = length - GRAM
    found = parse(df, length)
    again = scratch.cut(found.groupBy("gram").agg(F.count("*").alias("times")).where(F.col("times") > 1))
    met = scratch.cut(spread_join(found, again, ["gram"]))
    dictionary = scratch.cut(met.groupBy("gram", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("rep")))
    whole = spread_join(met, dictionary.where(F.col("n") > 1).select("gram", "phrase", F.col("n").alias("times")), ["gram", "phrase"]).select("key", "at", F.lit(side).alias("l"), F.lit(side).alias("r"))
    grams = dictionary.groupBy("gram").agg(F.count("*").alias("members"), F.count_if(F.col("n") == 1).alias("single")).where((F.col("members") > 1) & (F.col("single") > 0)).select("gram", "members")
    wanted = dictionary.join(grams, "gram").select("rep.key", "rep.at", "gram", "n", "members")
    phrases = scratch.cut(_phrases(df, wanted, length))
    crowd = phrases.where(F.col("members") > MAX_PAIRED)
    out = whole.unionByName(_compared(phrases, length)).unionByName(_counted(crowd, length, scratch))
    ranges = out.select("key", F.floor(F.col("at") / GRAM).alias("cell"), F.greatest(F.col("at") - F.col("l"), F.lit(0)).alias("lo"), (F.col("at") + GRAM + F.col("r")).alias("hi"))
    # both groupings are by key, or finer: one shuffle
    joined = ranges.repartition("key").groupBy("key", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = scratch.cut(joined.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")))
    for gone in (again, met, dictionary, phrases):
        scratch.drop(gone)
    return out


def remove_repeats(df: DataFrame, scratch: Scratch, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (the bytes outside every string of length bytes that starts twice)."""
    base = without(df, [f.name for f in OUTPUTS] + ["_key", "_covers"])
    docs = base.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    by_row = covers(docs, length, scratch).withColumnsRenamed({"key": "_key", "marks": "_covers"})
    joined = base.withColumn("_key", row_key(id_col, text_col)).join(by_row, "_key", "left").drop("_key")
    kept = [f for f in joined.schema.fields if f.name not in ("_covers", text_col)]
    schema = T.StructType(kept + OUTPUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, marks = b.column(b.schema.get_field_index(text_col)), b.column(b.schema.get_field_index("_covers"))
            for lo, hi in chunks(texts, 2_000_000):
                out = [cut_out((t or "").encode(), m or []) for t, m in zip(texts.slice(lo, hi - lo).to_pylist(), marks.slice(lo, hi - lo).to_pylist(), strict=True)]
                old = [b.column(b.schema.get_field_index(f.name)).slice(lo, hi - lo) for f in kept]
                made = [pa.array(list(c), type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(old + made, names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def cut_out(raw: bytes, marks: list[dict]) -> tuple[int, int, int, bytes]:
    spans: list[list[int]] = []
    for lo, hi in sorted((m["lo"], min(len(raw), m["hi"])) for m in marks):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return len(raw), sum(hi - lo for lo, hi in spans), len(spans), b"".join(kept)
