"""Line dedup, licence scans, similarity groups and the pipeline against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkframe.llm import licenses, lines, queries, simhash
from inkframe.llm.common import Scratch


def plain_dedup(rows, min_words):
    """(n_lines, n_removed, kept) of rows (id, text), by trying every run of every length."""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    split = [t.split("\n") for *_, t in docs]
    seen, gone = set(), [set() for _ in docs]
    for d, ls in enumerate(split):
        words = [x.count(" ") + 1 for x in ls]
        for s in range(len(ls)):
            total = 0
            for e in range(s, len(ls)):
                total += words[e]
                if total < min_words:
                    continue
                run = tuple(ls[s : e + 1])
                if run in seen:
                    gone[d].update(range(s, e + 1))
                seen.add(run)
    return {(i if ok else None, t): (len(ls), len(g), "\n".join(x for k, x in enumerate(ls) if k not in g)) for (ok, i, t), ls, g in zip(docs, split, gone, strict=True)}


@pytest.mark.parametrize("min_words", [1, 4, 7])
def test_line_dedup(spark, min_words):
    r = random.Random(min_words)
    some = ["", "a", "b c", "d e f", "g h i j", "k l"] + [f"u{i} v" for i in range(6)]
    rows = [(i, "\n".join(r.choice(some) for _ in range(r.randrange(0, 14)))) for i in range(60)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:10])] + [(None, "a\nb c\nd e f"), (200, None), (201, "\n\n\n"), (5, rows[5][1])]
    df = spark.createDataFrame([(*x, "old") for x in rows], "doc_id long, text string, kept string")
    want = plain_dedup(rows, min_words)
    got = lines.dedup_lines(df, Scratch(spark), min_words).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_lines, x.n_removed, x.kept) == (want[x.doc_id, x.text] if x.text is not None else (0, 0, None))
    assert lines.dedup_lines(df.limit(0), Scratch(spark), min_words).count() == 0


def test_line_dedup_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_dedup(docs, 30)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op2_line_dedup(spark, sf_dir).collect()}
    assert got == {i: (*want[i, t][:2], hashlib.sha256(want[i, t][2].encode()).hexdigest()) for i, t in docs}
    assert any(g[1] for g in got.values())


def test_licenses(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "p/LICENSE"),
        (2, "some words\nof a file", "p/src/a.txt"),
        (3, "x\ny\nz\nReleased under the MIT License.\nw", "p/src/b.txt"),
        (4, None, "p/src/deep/down/c.txt"),
        (5, "Released under the MIT license", "p/src/deep/COPYING"),
        (6, "", "q/d.txt"),
        (7, "a licence to do as one likes", "q/e.txt"),
        (1, "Licensed under the Apache License, Version 2.0.", "p/LICENSE"),
    ]
    df = spark.createDataFrame([(*x, "old") for x in rows], "doc_id long, text string, place string, license string")
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.scan(df, F.col("place")).collect()}
    assert got == {1: ("Apache-2.0", None), 2: ("Apache-2.0", "p"), 3: ("MIT", None), 4: ("MIT", "p/src/deep"), 5: ("MIT", None), 6: (None, None), 7: (None, None)}
    assert licenses.scan(df, F.col("place")).count() == 8 and licenses.scan(df.limit(0), F.col("place")).count() == 0


def test_licenses_together(spark):
    """Openings of licence files, notices over several lines, and paragraphs that name another licence."""
    gpl = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  13. Use with the GNU Affero General Public License.
"""
    apache = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
    notice = "\n".join(f" * {x}" for x in ("This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU{} General Public License as published by", "the Free Software Foundation, either version {} of the License, or", "(at your option) any later version."))
    under = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\nimport os'
    files = {
        "a/LICENSE": (gpl, "GPL-3.0"), "b/COPYING": (gpl.replace("Version 3, 29 June 2007", "Version 2, June 1991"), "GPL-2.0"), "c/LICENSE.txt": (apache, "Apache-2.0"),
        "d/LICENSE": (gpl.replace("GENERAL PUBLIC LICENSE\n", "LESSER GENERAL PUBLIC LICENSE\n", 1), "LGPL-3.0"), "e/LICENSE": ("Mozilla Public License Version 2.0\n====\n\n1. Definitions\n", "MPL-2.0"),
        "f/x.c": ("/*\n" + notice.format("", 3) + "\n */\nint x;", "GPL-3.0"), "f/y.c": (notice.format("", 2), "GPL-2.0"), "f/z.c": (notice.format(" Affero", 3), "AGPL-3.0"), "f/w.c": (notice.format(" Lesser", "2.1"), "LGPL-2.1"),
        "g/x.py": (under, "Apache-2.0"), "h/x.rs": ("// SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), "i/x.txt": ("plain\0 text\nof a file\n\n\0", None), "i/y.txt": ("", None), "i/z.txt": (None, None),
        "a/src/m.c": ("int y;", "GPL-3.0"), "j/LICENSE": ("\n\n \n", None),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "place string, text string")
    got = {r.place: r.license for r in licenses.scan(df, F.col("place"), together=True).collect()}
    assert got == {p: want for p, (_, want) in files.items()}
    assert licenses.scan(df.limit(0), F.col("place"), together=True).count() == 0


def test_license_query(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op10_licenses(spark, sf).collect()}
    names = {"CC BY-NC 4.0": "CC-BY-NC-4.0", "General Public License, version 3": "GPL-3.0", "Apache License, Version 2.0": "Apache-2.0", "the MIT License": "MIT"}
    marked = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = sorted({v for k, v in names.items() if k in r.text})
        if want:
            marked += 1
            assert found[r.doc_id].license == " AND ".join(want) and found[r.doc_id].inherited_from is None
    assert marked and len(found) == 1000


def jaccard(a, b, n=5):
    cut = lambda t: (lambda w: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})(re.findall(r"\S+", t.lower()))
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_similar_groups(spark):
    """Copies with one word in forty changed meet; others don't."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [[r.choice(words) for _ in range(r.randrange(120, 400))] for _ in range(60)]
    rows, close = [], []
    for i, b in enumerate(base):
        rows.append((i, " ".join(b)))
        c = list(b)
        for _ in range(max(1, len(c) // 80)):
            c[r.randrange(len(c))] = r.choice(words)
        rows.append((1000 + i, " ".join(c)))
        if jaccard(rows[-1][1], rows[-2][1]) >= 0.88:
            close.append(i)
    rows += [(5000, None), (5001, ""), (5002, "w1"), (5003, "w1")]
    got = {x.doc_id: x.least for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert len(close) > 30 and np.mean([got[1000 + i] == i for i in close]) > 0.95
    assert all(got[i] == i for i in range(60)) and got[5003] == 5002 and 5000 not in got and 5001 not in got


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, counts = Scratch(spark), []
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        counts.append(docs.count())
    assert all(r.round_trip for r in docs.collect()) and counts == sorted(counts, reverse=True) and counts[-1] > 100
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def pages_of(r, n, template, tails):
    """Pages of one template, each with a tail of its own of some length."""
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(template)]
    return [base + [r.choice(words) for _ in range(r.choice(tails))] for _ in range(n)]


def test_similar_groups_keeps_unlike_family(spark):
    """Pages of a template that are all below the similarity stay."""
    r = random.Random(11)
    rows = [(i, " ".join(p)) for i, p in enumerate(pages_of(r, 1000, 320, range(45, 66)))]
    some = [jaccard(rows[r.randrange(1000)][1], rows[i][1]) for i in range(200)]
    assert 0.7 < min(some) and sorted(some)[-2] < 0.8
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), Scratch(spark)).collect()
    assert sum(x.doc_id == x.least for x in got) == len(got) == 1000


def test_similar_groups_hot_template(spark):
    """Of thousands of pages of one template, each has one partner, and all of these are found."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i, p in enumerate(pages_of(r, 2000, 320, range(55, 66))):
        k = r.randrange(10, 38)
        rows += [(2 * i, " ".join(p)), (2 * i + 1, " ".join(p[:-k] + [r.choice(words) for _ in range(k)]))]
        assert jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), Scratch(spark)).collect()
    assert len(got) == 4000 and all(x.least == x.doc_id - x.doc_id % 2 for x in got)


@pytest.mark.parametrize("max_cell", [3, 48])
def test_similar_groups_exact(spark, max_cell):
    """Chains of changes and crowded cells give the groups that all pairs give."""
    r = random.Random(max_cell)
    texts = []
    for _ in range(3):
        now = [r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.randrange(60, 150))]
        for _ in range(70):
            texts.append(" ".join(now))
            if r.random() < 0.8:
                c = now if r.random() < 0.5 else list(now)
                lo = r.randrange(len(c) - 12)
                c[lo : lo + r.randrange(1, 12)] = [f"x{r.randrange(999)}" for _ in range(r.randrange(0, 12))]
                if c is not now:
                    texts.append(" ".join(c))
    texts += ["a b", "a b", "a b c", "A  b", "a"]
    above = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and above[i] != above[j]:
                lo, hi = sorted((above[i], above[j]))
                above = [lo if x == hi else x for x in above]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.least for x in simhash.similar_groups(df, Scratch(spark), max_cell=max_cell).collect()}
    assert got == dict(enumerate(above)) and 3 < len(set(above)) < len(texts) / 2


def test_similar_groups_by_fingerprints(spark, monkeypatch):
    """Without cells of shingles there are just the links of fingerprints within six bits, as far as they are similar."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(300)]
        for _ in range(4):
            texts.append(" ".join(base))
            base[r.randrange(300)] = r.choice(words)
    much = " ".join(r.choice(words) for _ in range(61))
    texts += [" ".join([much] * 60 + [r.choice(words) for _ in range(80)]) for _ in range(2)]  # linked, but not similar
    fps = [int(x) for x in simhash.fingerprints_of(texts)]
    above, apart = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.REACH:
                if jaccard(texts[i], texts[j]) < 0.8:
                    apart += 1
                elif above[i] != above[j]:
                    lo, hi = sorted((above[i], above[j]))
                    above = [lo if x == hi else x for x in above]
    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(simhash, "_pivot_pairs", lambda *_: none)
    monkeypatch.setattr(simhash, "_open_pairs", lambda *_: none)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.least for x in simhash.similar_groups(df, Scratch(spark)).collect()}
    assert got == dict(enumerate(above)) and apart and len(set(above)) <= len(texts) - 30


@pytest.mark.parametrize("distance", [2, 6])
def test_near_in_cells(distance):
    """The cells hold every pair within the distance; in a crowd each has a link to one before it."""
    r = random.Random(distance)
    turned = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    base = [r.getrandbits(64) for _ in range(150)]
    fps = sorted({turned(x, n) for x in base for n in (0, 0, distance, distance + 1)} | {turned(base[0], 1) for _ in range(90)})
    fp = np.array(fps, np.uint64)
    cells = simhash.grid_cells(fp, distance)
    u, v = simhash.near_in_cells(cells.view(np.int64).ravel(), np.repeat(fp.view(np.int64), cells.shape[1]), distance)
    got = {tuple(sorted((int(a), int(b)))) for a, b in zip(u.view(np.uint64), v.view(np.uint64), strict=True)}
    close = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= distance}
    family = {x for x in fps if (x ^ base[0]).bit_count() <= 2 * distance + 1}
    assert got <= close and {p for p in close if not set(p) & family} <= got and len(close) > 150
    assert {x for p in close for x in p} == {x for p in got for x in p}


def test_near_duplicates_of_any_id(spark):
    """Null and repeated ids: what differs in text stays, and of copies one stays."""
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(80))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    near = lambda t: t + " more words"
    rows = [(None, a), (None, b), (None, near(b)), (1, c), (1, d), (1, c), (2, near(d)), (3, e), (None, near(e)), (4, f), (4, near(f))]
    rows += [(None, None), (None, None), (5, None), (6, ""), (6, g), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    sure = [(None, a), (1, c), (1, d), (3, e), (None, None), (5, None), (6, ""), (6, g), (None, "")]
    assert len(got) == len(sure) + 2 and set(sure) < set(got)
    assert len({(None, b), (None, near(b))} & set(got)) == len({(4, f), (4, near(f))} & set(got)) == 1


def test_line_words(spark):
    """Words are parted by any white space, or not at all in some scripts; a row of blanks is no long run."""
    passages = {
        1: "\n".join("\t".join(f"a{i}f{k}" for k in range(12)) for i in range(10)),
        2: "\u00a0".join(f"b{i}" for i in range(40)),
        3: "\u6c49\u5b57\u6587\u672c" * 20,
        4: "\u0e01\u0e32\u0e23\u0e17" * 40,
        5: "\r\x0b".join(f"c{i}" for i in range(40)),
        6: " ".join(f"\u00e9{i}" for i in range(30)),
        7: " " * 40,
        8: " ".join(f"d{i}" for i in range(29)),
        9: "  ".join(f"e{i}" for i in range(20)),
        10: "\u6c49\u5b57" * 10,
    }
    rows = [(100 * c + i, f"own line {c} {i}\n{t}\nlast line {c} {i}") for i, t in passages.items() for c in (0, 1)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 30).collect()}
    assert {i: got[100 + i] for i in passages} == {1: 10, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0, 9: 0, 10: 0}
    assert not any(got[i] for i in passages)


def test_similar_groups_hot_shingle(spark, monkeypatch):
    """Groups don't depend on which shingles count as hot, nor on how pairs' texts are found."""
    r = random.Random(13)
    base = [f"w{r.randrange(900)}" for _ in range(200)]
    rows = [(i, " ".join(base[:100] + [f"x{i}a{k}" for k in range(i % 7)] + base[100:])) for i in range(300)]
    df = spark.createDataFrame([(*x, "old") for x in rows], "doc_id long, text string, node string")
    groups = lambda: sorted((x.doc_id, x.least) for x in simhash.similar_groups(df, Scratch(spark), max_cell=64).collect())
    want = groups()
    for name, value in (("HOT", 3), ("FEW", 0), ("SAMPLE", 1)):
        monkeypatch.setattr(simhash, name, value)
    assert groups() == want == [(i, 0) for i in range(300)]
    assert simhash.similar_groups(df.limit(0), Scratch(spark)).count() == 0


def test_met_rows_in_parts():
    """No row of a cell with several members, one of which leads, is lost, however rows fall into batches."""
    r = random.Random(4)
    for trial in range(300):
        rows = []
        for cell in range(r.randrange(1, 6)):
            n, lead = r.choice([1, 1, 2, 3, 5, 12]), r.choice([0, 1, 20])
            rows += [(cell, 100 * cell + i, 9, 5, i < lead) for i in range(n)]
        size = r.choice([1, 2, 3, 5, 50])
        table = pa.table({c: [x[i] for x in rows] for i, c in enumerate(("cell", "node", "size", "rest", "leads"))})
        batches = [b for at in range(0, len(rows), size) for b in table.slice(at, size).to_batches()] + [table.slice(0, 0).to_batches()[0] if table.slice(0, 0).to_batches() else table.to_batches()[0].slice(0, 0)]
        got = [x["node"] for b in simhash.met_rows(batches) for x in b.to_pylist()]
        assert got == [n for c, n, *_ in rows if sum(x[0] == c for x in rows) > 1 and any(x[4] for x in rows if x[0] == c)]
    assert list(simhash.met_rows([])) == []


def test_similar_groups_lone_leader_in_parts(spark):
    """Large cells cut into batches of 5 rows, members dealt over tasks: groups are those of all pairs."""
    r = random.Random(17)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join(base[:60] + [f"x{i}"] + base[60:])) for i in range(150)]
    rows += [(200 + i, " ".join(base[:25] + [f"y{i}n{k}" for k in range(300)])) for i in range(40)]  # share few shingles
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {x.doc_id: x.least for x in simhash.similar_groups(df, Scratch(spark), max_cell=16, max_dealt=7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: 0 if i < 200 else i for i, _ in rows}
