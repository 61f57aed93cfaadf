"""Bullet pairing against a plain greedy-free pairing, and medians by counts."""

import random
import statistics

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import entries as E
from termloom.operators import lines as L
from termloom.operators import versions as V

WORDS = "built led the team for data pipeline in rust and sold plans to small shops while running a lab".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_pairs(before, after, keys_of, threshold=0.34):
    def sim(x, y):
        if keys_of[x] == keys_of[y]:
            return 1.0
        x, y = x.lower().strip(), y.lower().strip()
        return 1 - distance(x, y) / max(len(x), len(y)) if x and y else 0.0

    grid = [[sim(x, y) for y in before] for x in after]
    best_a = [max(range(len(before)), key=lambda j: (r[j], -j)) for r in grid] if before else []
    best_b = [max(range(len(after)), key=lambda i: (grid[i][j], -i)) for j in range(len(before))] if after else []
    out, used = set(), set()
    for i, j in enumerate(best_a):
        if grid[i][j] > threshold and best_b[j] == i:
            out.add(("unchanged" if before[j] == after[i] else "rewritten", j, i, int(grid[i][j] * 100 + 0.5) / 100))
            used |= {("b", j), ("a", i)}
    out |= {("added", None, i, None) for i in range(len(after)) if ("a", i) not in used}
    return out | {("removed", j, None, None) for j in range(len(before)) if ("b", j) not in used}


def sentence(rng):
    return " ".join(rng.choices(WORDS, k=rng.randint(2, 9)))


def test_pairs_equal_a_plain_pairing(spark):
    rng = random.Random(3)
    rows = []
    for k in range(6):
        before = [sentence(rng) for _ in range(rng.randint(0, 20))]
        after = [rng.choice([t, t.upper(), t + " now", sentence(rng), t[: len(t) // 2]]) for t in before] + [sentence(rng) for _ in range(rng.randint(0, 6))]
        before += before[:3] + ["", "  "]
        rng.shuffle(after)
        rows.append((k, before, after + after[:2] + [""]))
    texts = sorted({t for _, b, a in rows for t in b + a})
    key = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_keyword("t").alias("k")).collect()}
    df = spark.createDataFrame(rows, "k int, before array<string>, after array<string>")
    for block in (4, 128):
        got = {}
        for r in V.pair_bullets(df, ["k"], block=block).collect():
            got.setdefault(r["k"], set()).add((r["kind"], r["from_no"], r["to_no"], r["sim"]))
        for k, before, after in rows:
            assert got[k] == plain_pairs(before, after, key), (block, k)


def test_pairs_of_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, None, ["one two"]), (2, [None, "one"], []), (3, [], []), (4, ["a b c", None], [None, "a b c"])],
                               "k int, before array<string>, after array<string>")
    got = sorted((r["k"], r["kind"], r["from_no"], r["to_no"]) for r in V.pair_bullets(df, ["k"]).collect() if r["k"] < 4)
    assert got == [(1, "added", None, 0), (2, "removed", 0, None), (2, "removed", 1, None)]
    four = {(r["kind"], r["from_no"], r["to_no"]) for r in V.pair_bullets(df.filter("k = 4"), ["k"]).collect()}
    assert four == {("unchanged", 0, 1), ("added", None, 0), ("removed", 1, None)}
    assert V.pair_bullets(df.limit(0), ["k"]).count() == 0


def test_one_large_entry_spreads_over_rows(spark):
    # 5,000 by 5,000 bullets of one entry: most settle by equality, the rest meets in blocks
    text = F.concat_ws(" ", F.sha1(F.col("i").cast("string")), F.md5(F.col("i").cast("string")))
    b = spark.range(5000).withColumnRenamed("id", "i").select("i", text.alias("t"))
    a = b.select("i", F.when(F.col("i") % 100 == 0, F.concat("t", F.lit(" revised"))).otherwise(F.col("t")).alias("t"))
    one = lambda x, c: x.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]).alias(c))
    pairs = one(b, "before").crossJoin(one(a, "after")).withColumn("k", F.lit(1))
    n = {r["kind"]: r["count"] for r in V.pair_bullets(pairs, ["k"]).filter("kind in ('added', 'removed') or from_no = to_no").groupBy("kind").count().collect()}
    assert n == {"unchanged": 4950, "rewritten": 50}


def test_blocks_bound_their_lists_and_leave_settled_pairs_out(spark):
    t = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("no"), F.col("id").cast("string").alias("text"), (F.col("id") % 2 == 0).alias("settled"))
    blocks = V._blocks(t, ["k"], 128)
    sizes = [r["n"] for r in blocks.select(F.size("texts").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 256 and len(sizes) == 32
    best = V._block_best(blocks.filter("settled"), blocks.filter("settled"), ["k"], 0.34)
    assert best.count() == 0


def test_medians_by_counts(spark):
    rng = random.Random(5)
    sizes = {d: [rng.choice([9.0, 10.0, 10.5, 11.0, 14.0, 18.0, 22.0, 3.0, 41.0]) for _ in range(rng.randint(1, 60))] for d in range(20)}
    sizes[98], sizes[99] = [None, None], [2.0, 50.0]
    rows = [(d, i, "text", s) for d, v in sizes.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "doc_id int, block_no int, kind string, font_size double")
    got = {r["doc_id"]: r for r in E.layout_profile(df).collect()}
    mid = {r["doc_id"]: r["m"] for r in L.upper_median(df, ["doc_id"], "font_size", "m").collect()}
    for d, v in sizes.items():
        known = [s for s in v if s is not None]
        assert mid.get(d) == (statistics.median_high(known) if known else None)
        ok = [s for s in known if 4 < s < 40]
        base = statistics.median_high(ok) if ok else None
        assert got[d]["base_size"] == base
        if base is not None:
            heads = [s for s in ok if s > base * 1.12]
            names = [s for s in ok if s > base * 1.45]
            assert got[d]["heading_size"] == (statistics.median_high(heads) if heads else base * 1.14)
            assert got[d]["name_size"] == (max(names) if names else base * 2.1)
