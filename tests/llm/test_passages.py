"""Repeated passages against brute force: every exact run is covered, every passage holds."""

import random

import numpy as np


def exact_runs(words, least=50):
    """Per document the word positions that lie in a run of at least `least` words of another document."""
    where = {}
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), []).append((d, i))
    out = {d: set() for d in words}
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                out[d].update(range(i, i + least))
    return out


def test_band_is_exact_where_it_counts():
    from termloom.llm.passages import _common

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(400):
        a = [r.randrange(30) for _ in range(r.randint(1, 90))]
        b = [x for x in a if r.random() > 0.1] if r.random() < 0.7 else [r.randrange(30) for _ in range(r.randint(1, 90))]
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.randrange(30))
        for spare in (4.0, 10.0, 30.0):
            got, want, longer = _common(np.array(a), np.array(b), spare), lcs(a, b), max(len(a), len(b))
            assert got <= want and (got == want or want < longer - spare)


def test_every_exact_run_is_covered(spark):
    from termloom.llm.passages import repeated_passages

    r = random.Random(7)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    passages = [fresh(n) for n in (50, 50, 51, 61, 70, 90, 120, 300, 700)]
    words = {}
    for d in range(160):
        text = fresh(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.random()
            if d < 40 and cut < 0.8:  # the least documents hold fragments, of which many are too short
                n = r.randint(10, len(p))
                at = r.randint(0, len(p) - n)
                p = p[at : at + n]
            text += p + fresh(r.randint(0, 40))
        words[d] = text
    words[900], words[901] = ["a"] * 500, ["a"] * 60 + fresh(5)
    rows = [(d, " ".join(w), 1, "x") for d, w in words.items()] + [(2000, None, 1, ""), (2001, "", 1, ""), (None, " ".join(passages[3]), 1, ""), (3, " ".join(words[3]), 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int, seed string")
    got = repeated_passages(docs).collect()
    held = {d: set() for d in words}
    for x in got:
        assert x.other_id != x.doc_id and x.n_words == x.end_word - x.start_word >= 50 and x.similarity >= 0.8
        assert x.end_word <= len(words[x.doc_id]) and x.other_end <= len(words[x.other_id])
        held[x.doc_id].update(range(x.start_word, x.end_word))
    for d, want in exact_runs(words).items():
        assert want <= held[d] or d == 900 and len(held[d]) >= 60, d
    for d in words:
        if not held[d]:
            continue
        assert exact_runs({k: w for k, w in words.items()}, 40)[d]  # nothing is found where not even 40 words repeat
    assert repeated_passages(docs.limit(0)).count() == 0


def test_very_long_texts_and_fuzzy_gaps(spark):
    from termloom.llm.passages import repeated_passages

    r = random.Random(8)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    p = fresh(3_000)
    other = p[:1_200] + fresh(300) + p[1_480:]  # one long gap, off the diagonal behind it
    rows = [(1, " ".join(fresh(200_000) + p)), (2, " ".join(fresh(50) + other))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mine = sorted((x.start_word, x.end_word) for x in got if x.doc_id == 2)
    assert mine and mine[0][0] == 50 and mine[-1][1] == 50 + len(other)


def near_pair(a, b, least=50, like=0.8):
    """Whether some stretch of that many words stands in both, place by place, with at least that share of words equal."""
    for shift in range(-len(b), len(a)):
        i = max(shift, 0)
        same = np.array(a[i : i + len(b)])[: max(len(b) - i + shift, 0)]
        same = same == np.array(b[i - shift : i - shift + len(same)])
        if len(same) >= least and (np.convolve(same, np.ones(least), "valid") >= like * least).any():
            return True
    return False


def test_near_repeats_behind_fragments_are_found(spark):
    """The least and the greatest documents hold fragments of every passage, so that no seed leads to a document with all of it."""
    from termloom.llm.passages import repeated_passages

    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    words, members = {}, []
    for g in range(25):
        passage = fresh(r.choice((60, 80, 120)))
        for at in range(0, len(passage), 20):
            for d in (g * 10 + at // 20, 5_000 + g * 10 + at // 20):
                words[d] = fresh(12) + passage[max(at - 2, 0) : at + 22] + fresh(12)
        for d in (1_000 + 2 * g, 1_001 + 2 * g):
            words[d] = fresh(15) + [w if i % 17 != (d % 2) * 5 + 6 else f"x{d}_{i}" for i, w in enumerate(passage)] + fresh(15)
            members.append(d)
    got = repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string")).collect()
    for x in got:
        assert x.similarity >= 0.8 and near_pair(words[x.doc_id], words[x.other_id])
    assert {x.doc_id for x in got} == set(members)


def test_periodic_words_give_few_passages(spark):
    from termloom.llm.passages import repeated_passages

    rows = [(d, " ".join([f"u{d}"] * 3 + ["ab", "cd"] * (60 + 7 * d) + [f"v{d}"] * 3)) for d in range(12)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = {d: set() for d, _ in rows}
    for x in got:
        held[x.doc_id].update(range(x.start_word, x.end_word))
    longest = 2 * (60 + 7 * 10)  # what another document holds
    assert all(len(held[d]) >= min(2 * (60 + 7 * d), longest) for d in held) and len(got) <= 6 * len(rows)


def test_windows_by_doubling():
    from termloom.llm.passages import of_windows

    r = np.random.default_rng(3)
    for n in (1, 2, 7, 8, 9, 40):
        x = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for w in range(1, n + 1):
            for fn in (np.minimum, np.maximum):
                assert of_windows(fn, x, w).tolist() == [fn.reduce(x[i : i + w]) for i in range(n - w + 1)]


def test_words_of_many_texts_get_numbers_once():
    from termloom.llm.passages import _Numbers, word_ids

    known = _Numbers()
    x, y = word_ids(b"a b a", known), word_ids(b"c b d", known)
    assert x.tolist() == [0, 1, 0] and y.tolist() == [2, 1, 3] and word_ids(b"", known).tolist() == []


def test_all_texts_of_a_repeated_key_are_aligned(spark):
    from termloom.llm.passages import repeated_passages

    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    p, q = fresh(70), fresh(90)
    texts = [(1, fresh(10) + p), (1, fresh(12) + q), (1, fresh(5)), (2, p + fresh(9)), (3, q + fresh(9)), (3, q + fresh(3))]
    rows = [(d, " ".join(w)) for d, w in texts]
    got = repeated_passages(spark.createDataFrame(rows + rows[:2], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.start_word, x.end_word) for x in got} == {(1, 10, 80), (1, 12, 102), (2, 0, 70), (3, 0, 90)}
    assert {x.other_id for x in got if x.doc_id == 2} == {1}
