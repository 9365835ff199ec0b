"""Texts turned for fill-in-the-middle training: cut at two unit ends, middle put last.

The texts of a batch lie in one array of bytes, each from a multiple of eight on, read as little-endian 64-bit words.
Arithmetic on whole words marks the bytes that end a unit (a line's newline, or the byte before a character's first);
the words' bit counts are summed along the array, and the k-th mark of a text is found by searching these sums for its
word and then taking away lower marks inside that word. The same sums of characters' first bytes give lengths in code
points.

Null and empty texts stay empty and plain; a text of one unit has an empty middle or is all middle; texts of any length
are cut whole; repeated rows (same draws) give equal rows; an empty table gives no rows; a null draw makes its row plain;
columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

SENTINELS = ("<P>", "<S>", "<M>")
FIELDS = [T.StructField("n_units", T.LongType()), T.StructField("output", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
ONES, LOW7, TOP = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from seed and key, the first 32-bit groups of a SHA-256; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, numbers: list[Column], unit: str = "line", rate: int = 100, spm_rate: int = 50, text_col: str = "text") -> DataFrame:
    """Adds form (plain, psm or spm), n_units, output, prefix_chars and middle_chars (code points; null if plain).

    numbers are four draws a row: two for the cuts, which lie behind any number of units from none to all, one for whether
    the text is turned (in rate of 100 cases), one for the form (spm in spm_rate of 100). Texts that hold a sentinel stay
    plain. unit is line or char.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"no unit {unit!r}")
    text = F.coalesce(text_col, F.lit(""))
    held = F.lit(False)
    for s in SENTINELS:
        held = held | F.contains(text, F.lit(s))
    whole = (text == "") | held | (numbers[2] % 100 >= rate)
    for x in numbers:
        whole = whole | x.isNull()
    form = F.when(F.coalesce(whole, F.lit(True)), "plain").when(numbers[3] % 100 < spm_rate, "spm").otherwise("psm")
    given = df.withColumns({"form": form, "_first": numbers[0], "_second": numbers[1]})

    def work(texts: list[str], forms: list[str], first: list[int | None], second: list[int | None]) -> list[list]:
        return list(turned([t.encode() for t in texts], forms, first, second, unit))

    return map_text(given, text_col, FIELDS, lambda: work, also=("form", "_first", "_second")).drop("_first", "_second")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    second = F.when(form == "spm", F.lit("<P>")).otherwise(F.lit("<S>"))
    i, j = F.position(second, output), F.position(F.lit("<M>"), output)
    one, two, middle = F.substring(output, F.lit(4), i - 4), F.substring(output, i + 3, j - i - 3), F.substring(output, j + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def turned(raw: list[bytes], forms: list[str], first: list[int | None], second: list[int | None], unit: str) -> tuple[list, list, list, list]:
    """Units, outputs, characters of the prefix and of the middle, for each text."""
    size = np.array([len(x) for x in raw], np.int64)
    begin = np.append(0, np.cumsum(-(-size // 8)))  # in words
    flat = np.zeros(8 * int(begin[-1]), np.uint8)
    for x, at in zip(raw, 8 * begin[:-1], strict=True):
        flat[at : at + len(x)] = np.frombuffer(x, np.uint8)
    words = flat.view("<u8")
    heads = char_heads(words, begin, size)
    head_sum = np.append(0, np.cumsum(np.bitwise_count(heads), dtype=np.int64))
    marks = newlines(words) if unit == "line" else before(heads, begin, size)
    mark_sum = np.append(0, np.cumsum(np.bitwise_count(marks), dtype=np.int64))
    own = mark_sum[begin[1:]] - mark_sum[begin[:-1]]
    # a last unit may end with the text, without a mark
    last = np.array([len(x) > 0 and unit == "line" and x[-1] != 10 for x in raw], np.int64)
    units = own + last
    cut = np.array([[0 if a is None else a, 0 if b is None else b] for a, b in zip(first, second, strict=True)], np.int64).reshape(-1, 2) % (units + 1)[:, None]
    cut.sort(axis=1)
    ends = np.stack([mark_place(marks, mark_sum, begin, own, size, cut[:, i]) for i in (0, 1)], axis=1)
    chars = np.stack([heads_before(heads, head_sum, begin, ends[:, i]) for i in (0, 1)], axis=1)
    outputs, prefix, middle = [], [], []
    for x, form, (a, b), (c, d) in zip(raw, forms, ends.tolist(), chars.tolist(), strict=True):
        p, m, s = x[:a], x[a:b], x[b:]
        made = x if form == "plain" else b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m
        outputs.append(made.decode())
        prefix.append(None if form == "plain" else c)
        middle.append(None if form == "plain" else d - c)
    return units.tolist(), outputs, prefix, middle


def newlines(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is a newline."""
    x = words ^ (ONES * np.uint64(10))
    return ~(((x & LOW7) + LOW7) | x | LOW7)


def char_heads(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The top bit of each byte of a text that begins a character: any but 10xxxxxx. Filling bytes are none."""
    heads = (~words | (words << np.uint64(1))) & TOP
    partly = size % 8 > 0
    at = begin[1:][partly] - 1
    heads[at] &= (np.uint64(1) << (np.uint64(8) * (size[partly] % 8).astype(np.uint64))) - np.uint64(1)
    return heads


def before(heads: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The top bit of each byte that ends a character: the one before a character's first, or the text's last."""
    nxt = np.append(heads[1:], np.uint64(0))
    nxt[begin[1:][size > 0] - 1] = 0  # the next word is another text's
    ends = (heads >> np.uint64(8)) | (nxt << np.uint64(56)) & TOP
    at = begin[1:][size > 0] - 1
    ends[at] |= np.uint64(0x80) << (np.uint64(8) * ((size[size > 0] - 1) % 8).astype(np.uint64))
    return ends


def mark_place(marks: np.ndarray, sums: np.ndarray, begin: np.ndarray, own: np.ndarray, size: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The byte of each text behind its k-th mark: its beginning for k = 0, its end for more marks than it has."""
    out = np.where(k > own, size, 0)
    use = np.flatnonzero((k > 0) & (k <= own))
    wanted = sums[begin[:-1][use]] + k[use]
    word = np.searchsorted(sums, wanted) - 1  # sums[word] < wanted <= sums[word + 1]
    rest, nth = marks[word], wanted - sums[word]
    for i in range(1, 8):
        more = nth > i
        rest[more] &= rest[more] - np.uint64(1)  # takes away the lowest mark
    low = rest & (~rest + np.uint64(1))
    byte = np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
    out[use] = 8 * (word - begin[:-1][use]) + byte + 1
    return out


def heads_before(heads: np.ndarray, sums: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many characters of each text begin before byte at."""
    word, byte = begin[:-1] + at // 8, (at % 8).astype(np.uint64)
    inside = byte > 0
    part = np.zeros(len(at), np.int64)
    part[inside] = np.bitwise_count(heads[word[inside]] & ((np.uint64(1) << (np.uint64(8) * byte[inside])) - np.uint64(1)))
    return sums[word] - sums[begin[:-1]] + part
