"""Centroid clustering, periodic runs and license scans against brute force, with odd rows."""

import hashlib
import math
import os
import random
import re
import tempfile
import zlib

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folder(spark, **tables):
    top = tempfile.mkdtemp(prefix="llm-tables-", dir="/tmp")
    for name, df in tables.items():
        df.write.parquet(f"{top}/{name}.parquet")
    return top


# ---- centroids


def brute_clusters(rows, dims, k, rounds, seed):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(x * 1024) if abs(x) < 2.0**52 else int(x) * 1024 for x in v], v))
    name = lambda key: (key is None, hashlib.sha256(f"{seed}:{key}".encode()).hexdigest())
    points = [v for _, v, _ in sorted(kept, key=lambda r: (name(r[0]), r[2]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(p, v), c) for c, p in enumerate(points))
    for _ in range(rounds):
        of = [near(v)[1] for _, v, _ in kept]
        points = [[sum(col) // of.count(c) for col in zip(*(r[1] for r, o in zip(kept, of, strict=True) if o == c), strict=True)] if c in of else p for c, p in enumerate(points)]
    got = [(key, *near(v)) for key, v, _ in kept]
    inertia = [sum(d for _, d, c in got if c == n) for n in range(len(points))]
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((key, c, fit(d), fit(inertia[c]), fit(sum(inertia)), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for key, d, c in got), key=repr)


def test_clusters_equal_brute_force(spark):
    from termloom.llm.centroids import cluster

    r = random.Random(5)
    grid = [(i, [float(r.randint(-2, 2)) / 4 for _ in range(4)]) for i in range(400)]  # many equal distances
    odd = [(None, [0.5] * 4), (7, [0.25] * 4), (7, [0.25] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0]), (903, [math.nan, 0.0, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [])]
    rows = grid + odd
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in rows], "vec_id long, embedding array<double>, distance string, cluster string")
    for k, rounds in ((8, 10), (3, 2), (20, 4)):
        got = sorted(map(tuple, cluster(df, dims=4, k=k, rounds=rounds).collect()), key=repr)
        assert got == brute_clusters(rows, 4, k, rounds, 3)
    few = df.where("vec_id in (1, 2)")
    assert sorted(map(tuple, cluster(few, dims=4).collect()), key=repr) == brute_clusters(grid[1:3], 4, 8, 10, 3)
    assert cluster(df.limit(0), dims=4).count() == 0 and cluster(df.where("vec_id >= 900"), dims=4).count() == 0


def test_clusters_of_very_large_components(spark):
    from termloom.llm.centroids import cluster

    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 6, 30, 200]) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cluster(df, dims=3, k=5, rounds=3).collect()
    want = brute_clusters(rows, 3, 5, 3, 3)
    assert sorted((x[:3] + x[5:] for x in map(tuple, got)), key=repr) == sorted((x[:3] + x[5:] for x in want), key=repr)


def test_tree_searches_agree():
    import numpy as np

    from termloom.llm.centroids import build, nearest, nearest_one

    r = random.Random(7)
    for _ in range(200):
        k, d = r.randint(1, 30), r.randint(1, 6)
        points = [[r.randint(-3, 3) for _ in range(d)] for _ in range(k)]
        vectors = [[r.randint(-4, 4) for _ in range(d)] for _ in range(40)]
        want = [min((sum((x - y) ** 2 for x, y in zip(p, v, strict=True)), c) for c, p in enumerate(points))[::-1] for v in vectors]
        tree = build(points)
        which, far = nearest(tree, np.array(vectors))
        assert list(zip(which.tolist(), far.tolist(), strict=True)) == want == [nearest_one(tree, v) for v in vectors]


def test_tree_leaves_branches_out():
    import numpy as np

    from termloom.llm import centroids

    r = np.random.default_rng(1)
    points = [[int(x) for x in p] for p in r.integers(-1000, 1000, (64, 2))]
    tree, seen = centroids.build(points), 0

    class Counting(list):
        def __getitem__(self, i):
            nonlocal seen
            seen += 1
            return list.__getitem__(self, i)

    counted = centroids.Tree(Counting(points), tree.nodes)
    for p in points:
        assert centroids.nearest_one(counted, p)[1] == 0
    assert seen < 64 * 64 / 2


# ---- runs


def brute_runs(words, exponent=4, least=6):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                a = i
                while i + q < n and words[i] == words[i + q]:
                    i += 1
                e = i + q
                if e - a >= max(least, exponent * q) and not any(all(words[x] == words[x + d] for x in range(a, e - d)) for d in range(1, q)):
                    out.append((a, e - a, q))
            i += 1
    return sorted(out)


def brute_op12(key, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_lyndon_lengths_by_definition():
    from termloom.llm.runs import lyndon

    r = random.Random(1)
    for _ in range(1500):
        s = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(1, 22))]
        s = [sorted(set(s)).index(x) for x in s]
        want = [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]
        assert lyndon(s) == want


def test_runs_of_many_texts_at_once():
    from termloom.llm.runs import runs_of

    r = random.Random(2)
    for _ in range(600):
        texts = []
        for _ in range(r.randint(0, 4)):
            n, k, s = r.randint(0, 60), r.randint(1, 5), []
            while len(s) < n:
                root = [r.randrange(k) for _ in range(r.randint(1, 7))]
                s += (root * 9)[: r.randint(2, 40)] if r.random() < 0.4 else [r.randrange(k + 4)]
            texts.append([b"%d" % x for x in s])
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            assert runs_of(texts, exponent, least) == [brute_runs(t, exponent, least) for t in texts]


def test_equal_hashes_change_nothing(monkeypatch):
    from termloom.llm import runs

    monkeypatch.setattr(runs, "_powers", lambda n: runs.np.zeros(n + 1, runs.np.uint64))  # every hash equal
    words = [b"%d" % x for x in [1, 2, 3, *[4, 5] * 6, 7, *[8] * 9, 1, 2]]
    assert runs.runs_of([words]) == [brute_runs(words)]


def test_op12_equals_brute_force(spark):
    from termloom.llm.queries import op12_runs

    keys = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 10 == 0][:60]
    r = random.Random(3)
    rows = [(k, " ".join(r.choice("a b c dd e1 é 漢字 F".split()) for _ in range(r.randint(1, 120)))) for k in keys]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 50), (4, "x " * 50), (4, "a b " * 30), (None, "y " * 9), (keys[0], None), (keys[1], ""), (keys[2], " lead\x0bx\x1cy z  a a a a a a a "), (5, "q\x00r " * 7)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, collapsed string, runs int")
    got = op12_runs(spark, folder(spark, documents=df)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_op12(*x) for x in rows), key=repr)
    assert op12_runs(spark, folder(spark, documents=df.limit(0))).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    got = op12_runs(spark, folder(spark, documents=real)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_op12(x.doc_id, x.text) for x in real.collect()), key=repr)


def test_very_long_and_periodic_texts(spark):
    from termloom.llm.runs import periodic_runs

    r = random.Random(4)
    noise = [str(r.randrange(10**6)) for _ in range(200_000)]
    rows = [(1, " ".join(noise + noise[:1000] * 5)), (2, "w " * 300_000), (3, " ".join(noise[:50_000] * 4))]
    got = {x.doc_id: (list(map(tuple, x.runs)), len(x.collapsed.split())) for x in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ([(200_000, 5000, 1000)], 201_000)
    assert got[2] == ([(0, 300_000, 1)], 1)
    assert got[3] == ([(0, 200_000, 50_000)], 50_000)


# ---- licenses

LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_op13(key, text):
    words = LOW.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return key, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_op13_base_equals_brute_force(spark):
    from termloom.llm.queries import op13_licenses

    texts = ["Released under the MIT License.", "under\nthe-mit_license! UNDER THE MIT LICENSE", "under the mit licensed", "xunder the mit license", "Licensed under the Apache License, Version 2.0.", "apache license version 20", "CC BY-NC 4.0 and cc.by.nc",
             "cc by nc cc by nc cc by nc", "é under the MIT license é", "under the mit licenseé", "", None, " ", "a" * 100_000, "under the mit license " * 5_000, "under the mit license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[0]), (None, texts[0])]
    df = spark.createDataFrame([(*x, "n", 3) for x in rows], "doc_id long, text string, labels string, n_words int")
    got = op13_licenses(spark, folder(spark, documents=df)).collect()
    assert sorted((tuple(x)[:6] for x in got), key=repr) == sorted((brute_op13(*x) for x in rows), key=repr)
    for x in got:
        assert 0 <= x.score <= 1 and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and (x.score > 0) == (x.labels != "")
        assert x.labels == ",".join(sorted(set(x.labels.split(","))))
    assert op13_licenses(spark, folder(spark, documents=df.limit(0))).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op13_licenses(spark, "/root/testdata/sf0.01").collect()
    assert sorted(tuple(x)[:6] for x in got) == sorted(brute_op13(x.doc_id, x.text) for x in real.collect())


def found(text):
    from termloom.llm.licenses import Scanner, all_rules, words_of

    return Scanner(all_rules()).scan(words_of(text))


def test_license_rules_and_suppression():
    labels = lambda t: sorted({d.label for d in found(t)})
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert labels("It is under the GNU Lesser General Public License v2.1 or so") == ["lgpl-2.1"]
    assert labels("see https://www.gnu.org/licenses/old-licenses/gpl-2.0.html today") == ["gpl-2.0"]
    assert labels("http://creativecommons.org/licenses/by-nc-sa/4.0/") == ["cc-by-nc-sa"]
    assert labels("the Mozilla Public License 2.0 and the MIT license") == ["mit", "mpl-2.0"]
    assert labels("CC BY-NC-SA 4.0") == ["cc-by-nc", "cc-by-nc-sa"]  # the base phrase stays inside the longer one
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files") == ["mit"]
    assert labels("wir kommen mit dem Zug, das Unter nehmen, a licence to kill, copyright of nobody") == []
    d = found("Released under the GNU GPL version 3 or any later version now")
    assert [(x.label, x.start, x.end) for x in d] == [("gpl-3.0-or-later", 0, 11)]


def test_rules_hold_their_keywords():
    """Hundreds of rules, each with its own name; no match is lost to the keywords: they are in every match of a rule."""
    import itertools

    from termloom.llm.licenses import NAMES, Scanner, all_rules

    rules = all_rules()
    assert len(rules) > 300
    scanner = Scanner(rules)
    texts = [f"{lead} {' '.join(n.split())} tail" for lead in ("licensed under the terms of the", "spdx license identifier", "subject to the") for _, tag, name, _ in NAMES for n in itertools.chain([tag.replace("(?:", "(").split("(")[0]], samples(name))]
    for t in texts:
        flat = b" " + " ".join(t.split()).encode() + b" "
        have = set(t.encode().split())
        for rule, need in zip(scanner.rules, scanner.needs, strict=True):
            if rule.pattern.search(flat):
                assert need <= have and have & scanner.anchors, (rule.name, t)


def samples(pattern):
    """Some texts that a name matches: each branch with its optional parts left out and taken."""
    from re import _constants as C
    from re import _parser

    def walk(items):
        out = [""]
        for op, arg in items:
            if op is C.LITERAL:
                got = [chr(arg)]
            elif op is C.IN:
                got = [chr(x) if o is C.LITERAL else "4" for o, x in arg[:2]]
            elif op is C.SUBPATTERN:
                got = walk(arg[3])
            elif op is C.BRANCH:
                got = [x for b in arg[1] for x in walk(b)]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                got = ([""] if arg[0] == 0 else []) + walk(arg[2])
            else:
                got = [""]
            out = [a + b for a in out for b in got][:400]
        return out

    return walk(_parser.parse(pattern))
