"""Near duplicates by SimHash, linked through segment popcounts.

A fingerprint's bits are cut into segments, and the segments' popcounts are its coordinates. Manhattan distance between
coordinates never exceeds the Hamming distance. Segments are dealt into distance + 3 groups; two fingerprints within the
distance have equal coordinates in at least 3 groups, so they meet in a grid cell made of 3 groups' coordinates. In each
cell pairs pass the Manhattan bound and then the exact distance. Cells with more than max_cell members would give too
many pairs: there, up to distance 2, each member instead names the cell's fingerprints with one bit turned (two are
within distance 2 exactly if they share such a name, or one is a name of the other), and all who share a name are hung
on its least member: a linear number of links that joins just the same components.

Equal fingerprints are one node from the start, so copies cost nothing. Null and empty texts have fingerprint zero and
are linked like any other; repeated rows share a component; an empty table gives no rows; a null doc_id is ignored as a
name, and its row has the component of its fingerprint; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, dealt_join, hot_keys, map_text
from .components import components

SEED = 42
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer texts are hashed shingle by shingle.
LONG_TEXT = 8_000_000
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of one buffer; the buffer must have 8 spare bytes behind the last span."""
    order = np.argsort(lengths, kind="stable")
    n = lengths[order].astype(np.int64)
    at = starts[order].astype(np.int64)
    words = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    lane = lambda i: words[i].view("<u8").ravel()
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(n), s + P5)
        left = n.copy()
        first = int(np.searchsorted(n, 32))
        if first < len(n):
            m = len(n) - first
            acc = [np.full(m, s + P1 + P2), np.full(m, s + P2), np.full(m, s), np.full(m, s - P1)]
            p, rest, lo = at[first:].copy(), n[first:].copy(), 0
            while lo < m:
                for k in range(4):
                    acc[k][lo:] = _round(acc[k][lo:], lane(p[lo:] + 8 * k))
                p[lo:] += 32
                rest[lo:] -= 32
                lo += int(np.searchsorted(rest[lo:], 32))  # those still here have had as many stripes, so they stay in order
            v = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                v = (v ^ _round(np.zeros_like(a), a)) * P1 + P4
            h[first:] = v
            at = at.copy()
            at[first:], left[first:] = p, rest
        h += n.astype(np.uint64)
        for _ in range(3):
            go = np.flatnonzero(left >= 8)
            if not len(go):
                break
            h[go] = _turn(h[go] ^ _round(np.zeros(len(go), np.uint64), lane(at[go])), 27) * P1 + P4
            at[go] += 8
            left[go] -= 8
        go = np.flatnonzero(left >= 4)
        if len(go):
            h[go] = _turn(h[go] ^ ((lane(at[go]) & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at[go] += 4
            left[go] -= 4
        for _ in range(3):
            go = np.flatnonzero(left > 0)
            if not len(go):
                break
            h[go] = _turn(h[go] ^ (buf[at[go]].astype(np.uint64) * P5), 11) * P1
            at[go] += 1
            left[go] -= 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    out = np.empty(len(h), np.uint64)
    out[order] = h
    return out


#: A byte's bits, one in each byte of an integer, so that up to 255 of them add up without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _majority(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For runs of hashes (first and count, run after run): bits set in over half of each run."""
    out = np.zeros(len(first), np.uint64)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    begin, n = first[has], count[has]
    # runs are cut into parts of at most 255
    parts = -(-n // 255)
    run_of = np.cumsum(parts) - parts
    at = np.repeat(begin - 255 * run_of, parts) + 255 * np.arange(int(parts.sum()))
    ends = np.append(at[1:], len(h))
    sums = np.empty((len(at), 64), np.uint8)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + 100_000, side="right")))
        lanes = LANES[h[at[lo] : ends[hi - 1]].astype(">u8").view(np.uint8)].reshape(-1, 8)
        sums[lo:hi] = np.add.reduceat(lanes, at[lo:hi] - at[lo], axis=0).view(np.uint8)
        lo = hi
    total = np.add.reduceat(sums, run_of, axis=0, dtype=np.int64)
    out[has] = np.packbits((2 * total > n[:, None]).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def shingle_hashes(raw: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles, and where each text's run of them begins and how long it is.

    There is no loop over words; texts over LONG_TEXT count as empty."""
    buf = np.frombuffer(b"\n".join(x if len(x) <= LONG_TEXT else b"" for x in raw) + b"\n", np.uint8)
    sizes = np.array([len(x) if len(x) <= LONG_TEXT else 0 for x in raw], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~SPACE[buf], [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # words again, with one space behind each, so that a shingle is one span
    n = ends - starts
    to = np.cumsum(n + 1) - n - 1
    packed = np.full(int((n + 1).sum()) + 64, 32, np.uint8)
    packed[np.repeat(to - starts, n) + np.flatnonzero(~SPACE[buf])] = buf[~SPACE[buf]]
    first_word = np.searchsorted(starts, begin)
    words = np.diff(np.append(first_word, len(starts)))
    grams = np.where(words == 0, 0, np.maximum(1, words - shingle + 1))
    total = int(grams.sum())
    run = np.cumsum(grams) - grams
    word = np.repeat(first_word - run, grams) + np.arange(total)
    last = word + np.repeat(np.minimum(words, shingle), grams) - 1
    h = xxh64_spans(packed, to[word], to[last] + n[last] - to[word]) if total else np.empty(0, np.uint64)
    return h, run, grams


def fingerprints_of(texts: list[str], shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text."""
    raw = [t.encode().lower() for t in texts]
    out = _majority(*shingle_hashes(raw, shingle))
    for i, x in enumerate(raw):
        if len(x) > LONG_TEXT:
            out[i] = _one_long(x, shingle)
    return out


def _one_long(raw: bytes, shingle: int) -> np.uint64:
    """The same for one long text in bounded memory."""
    sums, count = np.zeros(64, np.int64), 0
    for h in long_hashes(raw, shingle):
        sums, count = sums + bit_sums(h), count + len(h)
    return _over_half(sums, count)


def remix(h: np.ndarray, mix: np.uint64) -> np.ndarray:
    h = (h ^ mix) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def bit_sums(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def _over_half(sums: np.ndarray, count: int) -> np.uint64:
    return np.packbits((2 * sums > count).astype(np.uint8)).view(">u8")[0].astype(np.uint64)


def long_hashes(raw: bytes, shingle: int, size: int = 100_000) -> Iterator[np.ndarray]:
    """The same hashes for one long text, so many at once."""
    import re
    from collections import deque

    import xxhash

    count, part, recent = 0, [], deque(maxlen=shingle)
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
        recent.append(m[0])
        if len(recent) == shingle:
            part.append(xxhash.xxh64_intdigest(b" ".join(recent), SEED))
            count += 1
        if len(part) == size:
            yield np.array(part, np.uint64)
            part = []
    if recent and not count:
        part = [xxhash.xxh64_intdigest(b" ".join(recent), SEED)]
    if part:
        yield np.array(part, np.uint64)


def with_fingerprints(df: DataFrame, shingle: int = 3, text_col: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [fingerprints_of(texts, shingle).view(np.int64)]

    return map_text(df, text_col, [T.StructField(name, T.LongType())], make)


def popcounts(fp: Column, width: int) -> list[Column]:
    """The coordinates: how many bits each segment of so many bits has set."""
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(mask))) for i in range(0, 64, width)]


def cell_keys(fp: Column, distance: int, width: int = 2) -> Column:
    """The grid cells of a fingerprint: coordinates of every 3 of distance + 3 groups of segments."""
    coords = popcounts(fp, width)
    groups = distance + 3
    dealt = [coords[g::groups] for g in range(groups)]
    keys = []
    for k, chosen in enumerate(combinations(range(groups), 3)):
        # coordinates are at most width: written as digits, they fill one integer or two
        digits = [c.cast("long") for g in chosen for c in dealt[g]]
        parts = []
        for lo in range(0, len(digits), 20):
            value = F.lit(0).cast("long")
            for d in digits[lo : lo + 20]:
                value = value * (width + 1) + d
            parts.append(value)
        keys.append(F.xxhash64(F.lit(k), *parts))
    return F.array(*keys)


def links(fps: DataFrame, scratch: Scratch, distance: int = 2, max_cell: int = 48) -> DataFrame:
    """(u, v) links of distinct fingerprints (column fp): all pairs within the distance, or in crowded cells enough links
    to join all that such pairs would join. Crowded cells need distance <= 2; beyond it they are paired in full."""
    cells = fps.select("fp", F.explode(cell_keys(F.col("fp"), distance)).alias("cell"))
    size = cells.groupBy("cell").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    met = scratch.cut(cells.join(size, "cell"))
    few = met.where(F.col("members") <= max_cell) if distance <= 2 else met
    a, b = few.select("cell", F.col("fp").alias("u")), few.select("cell", F.col("fp").alias("v"))
    near = a.join(b, "cell").where(F.col("u") < F.col("v"))
    u, v = F.col("u"), F.col("v")
    manhattan = sum((F.abs(x - y) for x, y in zip(popcounts(u, 8), popcounts(v, 8), strict=True)), F.lit(0))
    out = near.where(manhattan <= distance).where(F.bit_count(u.bitwiseXOR(v)) <= distance).select("u", "v")
    if distance > 2:
        return out.distinct()
    many = met.where(F.col("members") > max_cell).select("fp").distinct()
    turned = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    named = many.select("fp", F.explode(turned).alias("name"))
    least = named.groupBy("name").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where(F.col("n") > 1)
    crowd = named.join(least, "name").where(F.col("u") != F.col("fp")).select("u", F.col("fp").alias("v"))
    # two that share a name differ in at most two bits
    return out.unionByName(crowd).distinct()


def near_duplicates(df: DataFrame, scratch: Scratch, shingle: int = 3, distance: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id): every row's fingerprint and the least id that it reaches over links."""
    marked = scratch.cut(with_fingerprints(df.select(id_col, text_col), shingle, text_col).select(id_col, "fp"))
    nodes = scratch.cut(marked.groupBy("fp").agg(F.min(id_col).alias("low")))
    joined = components(links(nodes.select("fp"), scratch, distance), scratch)
    placed = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "low", F.coalesce("least", "fp").alias("least"))
    names = placed.groupBy("least").agg(F.min("low").alias("component_id"))
    by_fp = placed.join(names, "least").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(id_col, "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- near duplicates by similarity, for filtering


#: One text in so many is sampled for frequent shingles; of those found MET times, at most FREQUENT are kept.
SAMPLE = 16
MET = 3
FREQUENT = 65_536
#: A shingle of so many sampled texts is not dealt out by its cell, which one task would have to sort.
HOT = 20_000
#: Rounds in which each cell tries one member with all others, before all pairs that are still apart.
ROUNDS = 2
PIVOTS = 4
#: Words of a set's fingerprint, of 64 bits each; a word is a segment.
WORDS = 8
#: For similar_groups, SimHash fingerprints link up to so many differing bits.
REACH = 6
#: In cells of over CROWD fingerprints each is linked to the nearest of the WINDOW before it only.
CROWD = 48
WINDOW = 256
#: Pairs whose texts' hashes, 16 bytes a pair, are broadcast.
FEW = 1_000_000
EPS = 1e-6


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode().lower() for t in texts]
    h, run, grams = shingle_hashes(raw, shingle)
    out = [np.unique(h[r : r + n]) for r, n in zip(run, grams, strict=True)]
    for i, x in enumerate(raw):
        if len(x) > LONG_TEXT:
            out[i] = np.unique(np.concatenate([np.empty(0, np.uint64), *long_hashes(x, shingle)]))
    return out


def set_name(x: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    with np.errstate(over="ignore"):
        total = remix(x, np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
        return int(remix(np.array([total]), np.uint64(len(x))).view(np.int64)[0])


def set_bits(x: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of hashes: each turns one bit. Two sets differ in at least as many hashes as their
    fingerprints do in bits, and these in at least as many bits as their segments' popcounts differ by."""
    turned = np.bincount((x >> np.uint64(20)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(turned.astype(np.uint8)).view(np.int64)


def _sets(df: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """Adds shingles, the distinct shingle hashes, and node, their name."""

    def make():
        def work(texts: list[str]) -> list[list]:
            sets = shingle_sets(texts, shingle)
            return [[x.view(np.int64) for x in sets], [set_name(x) for x in sets]]

        return work

    return map_text(df, text_col, [T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("node", T.LongType())], make)


def frequent_shingles(worded: DataFrame, shingle: int, text_col: str) -> tuple[np.ndarray, list[int]]:
    """Shingle hashes that many texts of a sample share, the most frequent last, and the hottest of them. Only speed
    depends on them."""
    some = worded.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0)
    each = _sets(some, shingle, text_col).select(F.explode("shingles").alias("h"))
    found = each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= MET).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return np.array([r.h for r in found], np.int64)[::-1].view(np.uint64), [r.h for r in found if r.n >= HOT]


def prefix_of(x: np.ndarray, similarity: float, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a text's shingles in an order that all texts share: the others by hash, then the frequent ones (hot, sorted,
    and their ranks). They are so many that two texts with the similarity share one."""
    n = len(x) - int(np.ceil(similarity * len(x) - EPS)) + 1 if len(x) else 0
    if not len(hot):
        return x[:n]
    at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
    is_hot = hot[at] == x
    return np.concatenate([x[~is_hot], x[is_hot][np.argsort(rank[at[is_hot]])]])[:n]


def _prefixed(df: DataFrame, shingle: int, similarity: float, frequent: np.ndarray, text_col: str) -> DataFrame:
    """Adds node, size (distinct shingles), bits (the set's fingerprint), prefix and fp, the SimHash."""

    def make():
        rank = np.argsort(frequent)
        hot = frequent[rank]

        def work(texts: list[str]) -> list[list]:
            fps = fingerprints_of(texts).view(np.int64)
            sets = shingle_sets(texts, shingle)
            return [[set_name(x) for x in sets], [len(x) for x in sets], [set_bits(x) for x in sets], [prefix_of(x, similarity, hot, rank).view(np.int64) for x in sets], fps]

        return work

    longs = T.ArrayType(T.LongType())
    return map_text(df, text_col, [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bits", longs), T.StructField("prefix", longs), T.StructField("fp", T.LongType())], make)


def grid_cells(fp: np.ndarray, distance: int) -> np.ndarray:
    """The grid cells of many fingerprints, as cell_keys makes them of 2-bit segments' popcounts: a row each."""
    odd = np.uint64(0x5555555555555555)
    counts, groups = (fp & odd) + ((fp >> np.uint64(1)) & odd), distance + 3
    masks = [sum(3 << 2 * x for x in range(g, 32, groups)) for g in range(groups)]
    mix = lambda k: np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    with np.errstate(over="ignore"):
        return np.stack([remix(counts & np.uint64(sum(masks[g] for g in chosen)), mix(k)) for k, chosen in enumerate(combinations(range(groups), 3))], axis=1)


def near_in_cells(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) fingerprints of one cell within the distance: all pairs, or those of the nearest before in a crowd."""
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order].view(np.uint64)
    n = len(cell)
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    members = np.diff(np.append(begin, n))
    crowded = np.repeat(members > CROWD, members)
    ones = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int8)
    i, us, vs = np.arange(n), [], []
    least, nearest = np.full(n, distance + 1, np.int64), np.zeros(n, np.int64)
    for d in range(1, WINDOW + 1):
        i = i[i < n - d]
        i = i[cell[i] == cell[i + d]]
        if not len(i):
            break
        x = i[np.abs(ones[i] - ones[i + d]).sum(1, dtype=np.int64) <= distance]
        apart = np.bitwise_count(fp[x] ^ fp[x + d]).astype(np.int64)
        x, apart = x[apart <= distance], apart[apart <= distance]
        few = x[~crowded[x]]
        us.append(few)
        vs.append(few + d)
        better = apart < least[x + d]
        x, apart = x[better], apart[better]
        least[x + d], nearest[x + d] = apart, x
    own = np.flatnonzero(crowded & (least <= distance))
    u, v = np.concatenate([*us, nearest[own]]).astype(np.int64), np.concatenate([*vs, own]).astype(np.int64)
    a, b = fp[u].view(np.int64), fp[v].view(np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def wide_links(fps: DataFrame, distance: int = REACH, max_dealt: int = 10_000) -> DataFrame:
    """(u, v) links of distinct fingerprints (column fp) that meet in a grid cell and are within the distance: all of them, but
    for crowded cells, whose members have a link each. Cells of over about max_dealt members are dealt over tasks."""

    def deal(batches):
        for b in batches:
            fp = b["fp"].to_numpy()
            for lo in range(0, len(fp), 4096):
                cells = grid_cells(fp[lo : lo + 4096].view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64).ravel()), pa.array(np.repeat(fp[lo : lo + 4096], cells.shape[1]))], names=["cell", "fp"])

    sampled = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(deal, "cell long, fp long")
    hot = sampled.groupBy("cell").count().where(F.col("count") > max_dealt // SAMPLE).select("cell", F.lit(True).alias("hot"))
    dealt = F.xxhash64("cell", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(64)))
    rows = fps.mapInArrow(deal, "cell long, fp long").join(F.broadcast(hot), "cell", "left")
    work = lambda t: [near_in_cells(t["cell"].to_numpy(), t["fp"].to_numpy(), distance)]
    return _by_cell(rows.select(F.when(F.col("hot"), dealt).otherwise(F.col("cell")).alias("cell"), "fp"), "cell", work, "u long, v long").distinct()


def _fingerprint_pairs(marked: DataFrame, scratch: Scratch, max_dealt: int) -> DataFrame:
    """(u, v) of nodes whose SimHash fingerprints are equal or linked. The least node of a fingerprint stands for it: it is
    paired with its others, and with the one of each fingerprint that is linked to its own."""
    named = scratch.cut(marked.select("fp", "node").distinct())
    first = scratch.cut(named.groupBy("fp").agg(F.min("node").alias("first")))
    same = dealt_join(named, first, ["fp"], hot_keys(named, ["fp"], scratch, max_dealt)).select(F.col("first").alias("a"), F.col("node").alias("b"))
    at_u, at_v = (first.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in ("ua", "vb"))
    near = wide_links(first.select("fp"), max_dealt=max_dealt).join(at_u, "u").join(at_v, "v").select("a", "b")
    return same.unionByName(near).where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _meets(x: Column, y: Column, similarity: float) -> Column:
    """Whether two rows (with size and rest) of a cell can have the similarity if the cell's shingle is their first common
    one. rest counts a text's shingles from that one on."""
    a, b = x["size"], y["size"]
    return (similarity * (a + b) <= (1 + similarity) * F.least(x["rest"], y["rest"]) + EPS) & (F.least(a, b) >= similarity * F.greatest(a, b) - EPS)


def _leads(similarity: float) -> Column:
    """Whether the cell's shingle is among a text's first ones, as many as it shares one of with a text of its size or more."""
    return (1 + similarity) * F.col("rest") + EPS >= 2 * similarity * F.col("size")


def _apart_by(similarity: float) -> float:
    """The share of two sets' summed sizes in which they may differ."""
    return (1 - similarity) / (1 + similarity)


def _by_cell(rows: DataFrame, key: str, work, schema: str) -> DataFrame:
    """work(columns of whole cells) in each task, rows sorted by key; it gives lists of columns."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        names = [x.split()[0] for x in schema.split(", ")]

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for columns in work(t):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            cell = t[key].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if cut:
                yield from done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def met_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of cells with several members, one of which leads. Rows come by cell, those that lead first, in batches of
    any size: a cell that goes on in the next batch keeps its state, and only one row is held back."""
    held: pa.RecordBatch | None = None
    going: tuple[int, bool] | None = None  # a cell of which rows have gone out or been left out, and which of these
    for b in chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        parts = [x for x in (held, b) if x is not None]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        cell, leads = t["cell"].to_numpy(), t["leads"].to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        members = np.diff(np.append(begin, len(cell)))
        use = (members > 1) & leads[begin]
        if going and going[0] == cell[0]:
            use[0] = going[1]
        every = np.repeat(use, members)
        n = len(cell) if b is None else len(cell) - 1
        going = (cell[n], every[n]) if n and b is not None and cell[n] == cell[n - 1] else going if not n else None
        held = None if b is None else t.slice(n)
        if n:
            yield t.slice(0, n).filter(pa.array(every[:n])).select(["cell", "node", "size", "rest"])


def _met(tokens: DataFrame, similarity: float, hot: list[int]) -> DataFrame:
    """The rows of cells with several members, one of which leads. Rows of hot shingles pass without being gathered."""
    is_hot = F.col("cell").isin(hot) if hot else F.lit(False)
    rows = tokens.where(~is_hot).withColumn("leads", _leads(similarity))
    met = rows.repartition("cell").sortWithinPartitions("cell", F.desc("leads")).mapInArrow(met_rows, "cell long, node long, size int, rest int")
    return met.unionByName(tokens.where(is_hot)) if hot else met


def _pivot_pairs(met: DataFrame, similarity: float, k: int, hot_cells: DataFrame) -> DataFrame:
    """(u, v) of each cell's pivot of round k, one of the members that lead, and all others that can have the similarity."""
    mix = F.xxhash64(F.col("node"), F.lit(k), F.pmod("cell", F.lit(PIVOTS)))
    pivot = met.where(_leads(similarity)).groupBy("cell").agg(F.min(F.struct(mix.alias("mix"), "node", "size", "rest")).alias("p"))
    each = dealt_join(met.select("cell", F.struct("node", "size", "rest").alias("m")), pivot, ["cell"], hot_cells).where(F.col("m.node") != F.col("p.node"))
    return each.where(_meets(F.col("m"), F.col("p"), similarity)).select(F.least("m.node", "p.node").alias("u"), F.greatest("m.node", "p.node").alias("v"))


def _open_pairs(met: DataFrame, roots: DataFrame, bits: DataFrame, similarity: float, block: int, hot_cells: DataFrame) -> DataFrame:
    """(u, v) of all pairs of cells that have different roots, pass the bounds and whose fingerprints are near enough.

    A cell of over block members is cut into blocks, and every two blocks meet, so no task holds a larger part of one.
    """
    rooted = met.join(roots.withColumnRenamed("least", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    cells = rooted.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("lo < hi")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = dealt_join(rooted, cells.select("cell", "blocks"), ["cell"], hot_cells).withColumn("own", own).withColumn("other", other)
    key = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    rows = placed.select(key.alias("key"), "node", "root", "size", "rest", "own", (F.col("own") == F.col("other")).alias("inner"))
    words = [f"b{i}" for i in range(WORDS)]
    wide = rows.join(bits.select("node", *[F.col("bits")[i].alias(w) for i, w in enumerate(words)]), "node")

    def work(t):
        key, node, root, own, inner = (t[c].to_numpy(zero_copy_only=False) for c in ("key", "node", "root", "own", "inner"))
        size, rest = t["size"].to_numpy().astype(np.int64), t["rest"].to_numpy().astype(np.int64)
        fp = np.stack([t[w].to_numpy() for w in words], axis=1).view(np.uint64)
        ones = np.bitwise_count(fp).astype(np.int16)
        i, held, count = np.arange(len(key)), [], 0
        for d in range(1, len(key)):
            i = i[i < len(key) - d]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            j = i + d
            a, b = size[i], size[j]
            ok = (root[i] != root[j]) & (inner[i] | (own[i] != own[j])) & (similarity * (a + b) <= (1 + similarity) * np.minimum(rest[i], rest[j]) + EPS)
            ok &= np.minimum(a, b) >= similarity * np.maximum(a, b) - EPS
            x, y = i[ok], j[ok]
            most = _apart_by(similarity) * (size[x] + size[y]) + EPS
            ok = np.abs(ones[x] - ones[y]).sum(1) <= most
            x, y, most = x[ok], y[ok], most[ok]
            ok = np.bitwise_count(fp[x] ^ fp[y]).sum(1, dtype=np.int64) <= most
            x, y = x[ok], y[ok]
            if len(x):
                held.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1))
                count += len(x)
            if count > 1_000_000:
                pairs = np.unique(np.concatenate(held), axis=0)
                yield [pairs[:, 0], pairs[:, 1]]
                held, count = [], 0
        if held:
            pairs = np.unique(np.concatenate(held), axis=0)
            yield [pairs[:, 0], pairs[:, 1]]

    return _by_cell(wide, "key", work, "u long, v long")


def _near(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose fingerprints are near enough: by segment popcounts, then bit by bit."""
    at_u, at_v = (bits.select(F.col("node").alias(x), F.struct("size", "bits").alias(f"at_{x}")) for x in "uv")
    both = pairs.join(at_u, "u").join(at_v, "v")
    most = _apart_by(similarity) * (F.col("at_u.size") + F.col("at_v.size")) + EPS
    a, b = ([F.col(f"at_{x}.bits")[i] for i in range(WORDS)] for x in "uv")
    manhattan = sum((F.abs(F.bit_count(x) - F.bit_count(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    hamming = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return both.where((manhattan <= most) & (hamming <= most)).select("u", "v")


def _verified(pairs: DataFrame, bits: DataFrame, worded: DataFrame, shingle: int, similarity: float, text_col: str) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have the Jaccard similarity. Only the texts of these pairs are read again."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    named = bits.join(wanted, "node", "left_semi").select("text_hash")
    # the hashes go to the texts if they are few, or else the texts to the hashes
    named = F.broadcast(named) if pairs.count() <= FEW else named
    texts = worded.select(text_col).withColumn("text_hash", F.xxhash64(text_col)).join(named, "text_hash", "left_semi")
    sets = _sets(texts, shingle, text_col).select("node", "shingles").dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where((1 + similarity) * common + EPS >= similarity * (F.size("a") + F.size("b"))).select("u", "v")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes aren't joined yet."""
    at_u, at_v = (roots.select(F.col("node").alias(x), F.col("least").alias(f"root_{x}")) for x in "uv")
    met = pairs.join(at_u, "u", "left").join(at_v, "v", "left")
    return met.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def similar_groups(df: DataFrame, scratch: Scratch, shingle: int = 5, similarity: float = 0.8, max_cell: int = 2048, max_dealt: int = 10_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, least) of rows with words: the least id that each reaches over links of texts with that Jaccard similarity.

    Exact: every pair with the similarity is joined, and every link has been compared shingle by shingle. Texts with equal
    shingle sets are one node. First come the links of the SimHash fingerprints that near_duplicates has, up to REACH bits:
    through the grid of their segments' popcounts, the Manhattan bound and the exact distance (see wide_links). What has the
    similarity is joined.

    A SimHash bounds no Jaccard similarity, so the pairs that it leaves apart are looked for once more: all texts sort their
    shingles in one order, and two with the similarity share one of their first few; the more so as frequent shingles come
    last. Pairs meet in the cells of those shingles and must pass the bounds that sizes and places give, then those of the
    sets' fingerprints: segment popcounts differ by no more than the fingerprints' bits, and those by no more than the sets.
    Each cell first tries one member with all others, twice, and what is alike is joined; then all pairs of a cell that are
    still apart are tried, in blocks of max_cell. So a large group of like texts costs no square of its size. Members of a
    cell of over max_dealt are dealt over several tasks; neither number changes the groups. Hashes of 64 bits stand for
    shingles, sets and texts.

    A null id is ignored as a name. Null and empty texts and those without words are left out; repeated rows share a
    group; an empty table gives no rows; other columns are not looked at.
    """
    mark = len(scratch.made)
    worded = df.select(id_col, text_col).where(F.col(text_col).rlike(r"\S"))
    frequent, hot = frequent_shingles(worded, shingle, text_col)
    marked = _prefixed(worded.withColumn("text_hash", F.xxhash64(text_col)), shingle, similarity, frequent, text_col)
    marked = scratch.cut(marked.select(id_col, "text_hash", "node", "size", "bits", "prefix", "fp"))
    bits = scratch.cut(marked.groupBy("node").agg(F.first("size").alias("size"), F.min("text_hash").alias("text_hash"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")))
    tokens = bits.select("node", "size", F.posexplode("prefix").alias("pos", "cell")).select("cell", "node", "size", (F.col("size") - F.col("pos")).alias("rest"))
    met = scratch.cut(_met(tokens, similarity, hot))
    hot_cells = hot_keys(met, ["cell"], scratch, max_dealt)
    roots = None
    for k in range(-1, ROUNDS + 1):
        if k < 0:
            tried = _near(_fingerprint_pairs(marked, scratch, max_dealt), bits, similarity)
        elif k < ROUNDS:
            tried = _apart(_near(_pivot_pairs(met, similarity, k, hot_cells).distinct(), bits, similarity), roots)
        else:
            tried = _open_pairs(met, roots, bits, similarity, max_cell, hot_cells).distinct()
        tried = scratch.cut(tried)
        alike = _verified(tried, bits, worded, shingle, similarity, text_col)
        links = alike if roots is None else alike.unionByName(roots.select(F.col("least").alias("u"), F.col("node").alias("v")))
        roots = scratch.cut(components(links, scratch))
        scratch.drop_since(mark, marked, bits, met, hot_cells, roots)
    scratch.drop_since(mark, marked, roots)
    placed = marked.select(id_col, "node").join(roots, "node", "left").select(id_col, F.coalesce("least", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min(id_col).alias("least"))
    return placed.join(names, "root").select(id_col, "least")
