"""Token counts by greedy longest match, in one pass over each word.

The vocabulary's byte strings form a trie. Every node carries a failure link (where matching goes on once the longest
tokens so far are taken off) and the number of tokens taken off on the way, so a word's count is a sum over its bytes
and no piece is ever built. A word is a maximal run without white space, with one space before it: tokens that begin
with a space start words, the others continue them.

Null, empty and blank texts have no words and no tokens; repeated rows give equal counts; an empty table gives no rows;
columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import load_tokens
from .common import map_text

OUTPUTS = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
MAX_CACHE = 500_000


class Matcher:
    def __init__(self, tokens: list[bytes]):
        """tokens must hold every single byte, so that every word can be cut."""
        step, depth_first = {}, []
        ends, count = set(), 1
        for t in tokens:
            at = 0
            for b in t:
                if (at, b) not in step:
                    step[at, b] = count
                    depth_first.append((at, b, count))
                    count += 1
                at = step[at, b]
            ends.add(at)
        fail, pops = [-1] * count, [0] * count
        level, order = {0: []}, []
        for parent, b, child in depth_first:
            level.setdefault(parent, []).append((b, child))
        queue = [0]
        for u in queue:
            for b, v in level.get(u, ()):
                queue.append(v)
                order.append((u, b, v))
        for u, b, v in order:
            if v in ends:
                fail[v], pops[v] = 0, 1
                continue
            z, n = fail[u], pops[u]
            while z >= 0 and (z, b) not in step:
                n += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = step[z, b], n
        self.next: list[dict[int, int]] = [{} for _ in range(count)]
        for (u, b), v in step.items():
            self.next[u][b] = v
        self.fail, self.pops = fail, pops

    def count(self, word: bytes) -> int:
        nxt, fail, pops = self.next, self.fail, self.pops
        u = n = 0
        for b in word:
            while (v := nxt[u].get(b)) is None:
                n += pops[u]
                u = fail[u]
            u = v
        while u:
            n += pops[u]
            u = fail[u]
        return n


class _Counts(dict):
    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_CACHE:
            self.clear()
        n = self[word] = self.matcher.count(b" " + word.encode())
        return n


_made: dict[str, _Counts] = {}


def token_counts(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Adds n_words and n_tokens. The vocabulary file has a fixed size; the driver reads it and broadcasts its tokens."""
    shared = df.sparkSession.sparkContext.broadcast(load_tokens(vocabulary))

    def make():
        if vocabulary not in _made:
            _made[vocabulary] = _Counts(Matcher(shared.value))
        counts = _made[vocabulary]

        def work(texts: list[str]) -> list[list]:
            words = [t.split() for t in texts]
            return [[len(w) for w in words], [sum(map(counts.__getitem__, w)) for w in words]]

        return work

    return map_text(df, text_col, OUTPUTS, make)
