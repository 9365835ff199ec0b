"""Stretches of words that repeat periodically.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least `least` words and
`times` periods (4 or more). Periods up to SHORT are found by comparing the words with those q further on. Longer ones
come from minimizers, a scale for each doubling: at scale K, for periods from K/2 + 1 to K, every K words in a row are
hashed, and the positions that are least in some window of K/2 + 1 positions are selected. The q rotations of a period
differ from one another and a window is no longer than a period, so inside a run the selected positions repeat at
distance q, and two neighbouring positions of equal hash are just q apart: each such pair seeds a comparison of words
that is extended to both sides. A run of four periods holds such a pair at its scale, so none is lost unless two of its
64-bit hashes collide; what is put out has been compared word by word.

Null and empty texts have no words and no runs; texts of any length are processed whole, many short ones at a time;
repeated rows give equal rows; an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

#: Periods up to this one are scanned lag by lag.
SHORT = 16
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def periodic_runs(df: DataFrame, text_col: str = "text", least: int = 6, times: int = 4, loop_col: str | None = None) -> DataFrame:
    """Adds n_words, runs (start as word number, length and period in words; by start, then period) and collapsed: the words
    kept, joined by blanks, without those that a run contains after its first period.

    loop_col, for tests with runs of known place, names a column g: where it isn't null, the words from word a = g % n on
    are first replaced by repetitions of the 1 + (n - a) // (3 + g % 8) words there.
    """
    if times < 4 or least < 1:
        raise ValueError("runs have four periods or more")

    def work(texts: list[str], loops: list[int | None] | None = None) -> list[list]:
        words = [t.encode().split() for t in texts]
        if loops:
            words = [looped(w, g) for w, g in zip(words, loops, strict=True)]
        runs = find_runs(words, least, times)
        return [[len(w) for w in words], [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], [collapse(w, own) for w, own in zip(words, runs, strict=True)]]

    return map_text(df, text_col, FIELDS, lambda: work, also=(loop_col,) if loop_col else ())


def looped(words: list[bytes], g: int | None) -> list[bytes]:
    """The words with repetitions planted by the number g."""
    n = len(words)
    if g is None or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    dropped = np.cumsum(step[:-1]) > 0
    return b" ".join([w for w, gone in zip(words, dropped, strict=True) if not gone] if len(runs) else words).decode()


def find_runs(docs: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    # the longest first, so that those long enough for a scale come before the others
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    number: dict[bytes, int] = {}
    x, begin = [], [0]
    for k, i in enumerate(order):
        x += [number.setdefault(w, len(number)) for w in docs[i]]
        x.append(-1 - k)  # differs from all else: no run goes on in the next text
        begin.append(len(x))
    at, begin = np.array(x, np.int64), np.array(begin)
    sizes = np.diff(begin) - 1
    found = [r for q in range(1, SHORT + 1) for r in stretches(at, q, max(least - q, (times - 1) * q))]
    scale, hashes, width = 2 * SHORT, mixed(at.view(np.uint64)), 1
    while len(sizes) and sizes[0] >= times * (scale // 2 + 1):
        end = int(begin[np.searchsorted(-sizes, -times * (scale // 2 + 1), side="right")])
        while width < scale:
            hashes = hashes[:end]
            hashes = mixed(hashes[:-width] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(hashes[width:]))
            width *= 2
        found += extended(at, seeds(hashes[: end - scale + 1], scale), times - 1)
        scale *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for start, length, q in sorted({(s, n + q, q) for s, n, q in found if n + q >= least and not divisible(at, s, n + q, q)}, key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(begin, start, side="right")) - 1
        out[order[k]].append((start - int(begin[k]), length, q))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretches(x: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, q) where at least so many words in a row are the same as those q further on."""
    same = np.flatnonzero(x[:-q] == x[q:])
    if len(same) < least:
        return []
    first = np.flatnonzero(np.append(True, np.diff(same) != 1))
    length = np.diff(np.append(first, len(same)))
    use = length >= least
    return [(int(s), int(n), q) for s, n in zip(same[first[use]], length[use], strict=True)]


def seeds(h: np.ndarray, scale: int) -> np.ndarray:
    """(lag, position) of selected positions and the next one of equal hash, for the lags of the scale; sorted."""
    half = scale // 2
    if len(h) <= half:
        return np.empty((0, 2), np.int64)
    low = slid(np.minimum, h, half + 1)
    pad = np.zeros(half, h.dtype)
    chosen = np.flatnonzero(slid(np.maximum, np.concatenate([pad, low, pad]), half + 1) == h)
    chosen = chosen[np.argsort(h[chosen], kind="stable")]
    lag = np.diff(chosen)
    use = (h[chosen[1:]] == h[chosen[:-1]]) & (lag > half) & (lag <= scale)
    out = np.stack([lag[use], chosen[:-1][use]], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def slid(of, h: np.ndarray, width: int) -> np.ndarray:
    """The least (or greatest) of each width values in a row; width is a power of two and one more."""
    w = 1
    while w < width - 1:
        h = of(h[:-w], h[w:])
        w *= 2
    return of(h[:-1], h[1:])


def extended(x: np.ndarray, found: np.ndarray, periods: int) -> list[tuple[int, int, int]]:
    """(start, length, lag) of the stretches around seeds where words are the same as those a lag further on, if that holds
    for so many lags."""
    out, lag, end = [], 0, 0
    for q, m in found.tolist():
        if q == lag and m < end:
            continue  # lies in the stretch of the seed before
        back = common(x[: m + q][::-1], x[:m][::-1])
        lag, end = q, m + common(x[m:], x[m + q :])
        if end - m + back >= periods * q:
            out.append((m - back, end - m + back, q))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements are the same from the beginning on."""
    n, lo, step = min(len(a), len(b)), 0, 64
    while lo < n:
        hi = min(n, lo + step)
        other = np.flatnonzero(a[lo:hi] != b[lo:hi])
        if len(other):
            return lo + int(other[0])
        lo, step = hi, 4 * step
    return n


def divisible(x: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether a stretch with period q also has a smaller one, which then divides q."""
    p, rest = 2, q
    while rest > 1:
        if rest % p == 0:
            d = q // p
            if (x[start : start + length - d] == x[start + d : start + length]).all():
                return True
            while rest % p == 0:
                rest //= p
        p = p + 1 if p * p <= rest else max(p + 1, rest)
    return False
