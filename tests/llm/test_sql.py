"""The subpackage's SQL, and licence scans against a plain version."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from inkframe.llm import licenses, queries


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(str(tuple(r)) for r in df.select(*cols).collect())
    assert got and got == Counter(map(str, c.execute(f"SELECT {','.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()))


def plain_scan(files, threshold=0.6, margin=0.01):
    """{path: (license, similarity, inherited_from)} of files {path: text}."""
    header, named = re.compile(licenses.HEADER), re.compile(licenses.LICENCE_FILE)
    heads = {p: [x for x in (t or "").split("\n") if header.search(x)] + ([t] if t and named.search(p) else []) for p, t in files.items()}
    words = lambda x: Counter(w.strip(".") for w in re.split(r"[^\w.+]+|_+", x.lower()) if w.strip(". "))
    times = Counter(x for hs in heads.values() for x in hs)
    for _, x in licenses.TEMPLATES:
        times[x] += 1
    total, seen = sum(times.values()), Counter()
    merged = Counter(x for hs in heads.values() for x in hs)
    for x, n in merged.items():
        for w in words(x):
            seen[w] += n
    for _, x in licenses.TEMPLATES:
        for w in words(x):
            seen[w] += 1
    # a text that is also a template counts with its files where words are counted once a text
    idf = {}
    rows = list(merged.items()) + [(x, 1) for _, x in licenses.TEMPLATES]
    by_line = {}
    for x, n in rows:
        by_line[x] = max(n, by_line.get(x, 0))
    df = Counter()
    for x, n in by_line.items():
        for w in words(x):
            df[w] += n
    idf = {w: math.log((total + 1) / (n + 1)) + 1 for w, n in df.items()}
    copies = Counter(x for x, _ in rows)

    def unit(x):
        v = {w: copies[x] * n * idf[w] for w, n in words(x).items()}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {w: a / norm for w, a in v.items()}

    known = [(lic, unit(x)) for lic, x in licenses.TEMPLATES]
    found = {}
    for x in merged:
        v, best = unit(x), {}
        for lic, t in known:
            c = round(sum(a * t[w] for w, a in v.items() if w in t), 6)
            if c >= threshold:
                best[lic] = max(c, best.get(lic, 0))
        ranked = sorted((-c, lic) for lic, c in best.items())
        if ranked and -ranked[0][0] + (ranked[1][0] if len(ranked) > 1 else 1) > margin:
            found[x] = (ranked[0][1], -ranked[0][0])
    own = {p: (" AND ".join(sorted({found[x][0] for x in hs if x in found})), max((found[x][1] for x in hs if x in found), default=None)) for p, hs in heads.items()}
    dirs = {}
    for p, t in files.items():
        n = sum(1 for x in (t or "").split("\n") if header.search(x))
        if own[p][0] and (2 * n >= len(t.split("\n")) or named.search(p)):
            dirs.setdefault(p.rpartition("/")[0], []).append((-own[p][1], own[p][0]))
    out = {}
    for p in files:
        if own[p][0]:
            out[p] = (*own[p], None)
            continue
        d, out[p] = p.rpartition("/")[0], (None, None, None)
        while True:
            if d in dirs:
                s, lic = min(dirs[d])
                out[p] = (lic, -s, d)
                break
            if not d:
                break
            d = d.rpartition("/")[0]
    return out


def test_licenses_plain(spark):
    r = random.Random(9)
    base = [x for _, x in licenses.TEMPLATES] + ["Licensed under CC BY-SA 4.0.", "Copyright 2020 by us", "all licences are free software", "under the GNU Affero General Public License, version 3, licensed", "SPDX-License-Identifier: MIT OR Apache-2.0"]
    files = {"top.txt": "plain", "LICENSE": licenses.MIT + "\nmore words here", "d0/COPYING": licenses.BSD3, "d0/e1/Notice.md": "long " * 5000 + "\nlicensed", "d1/empty": "", "d1/none": None}
    for i in range(120):
        d = "/".join(f"{r.choice('de')}{r.randrange(3)}" for _ in range(r.randrange(4)))
        text = "\n".join(" ".join(w for w in r.choice(base).split("\n")[0].split() if r.random() < 0.85) if r.random() < 0.4 else f"own line {i}" for _ in range(r.randrange(1, 5)))
        files[f"{d}/f{i}.txt" if d else f"f{i}.txt"] = text
    df = spark.createDataFrame([(p, t, "old", 1.5) for p, t in files.items()] * 2, "place string, text string, license string, _heads double").repartition(6)
    got = licenses.scan(df, F.col("place")).collect()
    want = plain_scan(files)
    assert len(got) == 2 * len(files) and len({w[0] for w in want.values()}) > 5 and any(w[2] for w in want.values())
    for x in got:
        lic, sim, up = want[x.place]
        assert (x.license, x.inherited_from) == (lic, up) and (sim is None or abs(x.similarity - sim) < 2e-6)
