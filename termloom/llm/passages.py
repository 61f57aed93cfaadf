"""Substring dedup: passages that repeat, exactly or nearly, in other documents, by collinear chaining.

Seeds are k-mers of words chosen by minimisers, so that two texts that share a run of k + window - 1 words
share a seed. A seed joins each of its occurrences to one anchor, the least document that has it (that one
joins the greatest), so a passage that thousands of documents share costs one match each and no pairs of
them. An anchor may hold a fragment only, so exact runs of least_words words that this leaves out meet in a
second round through hashes of whole runs, which no fragment holds; they are made only where a document has a stretch
of shared seeds that no passage covers, and where others hold the seeds of such stretches. Near repeats that are left
out meet in a third round through pairs of seeds within the length of a passage, which a fragment with one of them
does not hold. Ordered matches of a document and its anchor are chained with gap costs through a Fenwick tree, and
chains are aligned on the words of both texts, beyond their ends, to give the passages.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import pieces, stored
from termloom.llm.secrets import bloom, filter_bits, in_bloom

K = 5
WINDOW = 8
LEAST_WORDS = 50
LEAST_SIMILAR = 0.8
GAP_COST = 0.15  # per word of either text between two seeds; a seed earns K
FILTER_BITS = 1 << 22


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_ids(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def of_windows(fn: np.ufunc, x: np.ndarray, window: int) -> np.ndarray:
    """The least or greatest of every window, by windows of doubled length."""
    have = 1
    while have < window:
        step = min(have, window - have)
        x = fn(x[: len(x) - step], x[step:])
        have += step
    return x


def seeds(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, word positions and whether it is the first such hash, of the k-mers that are least in some window."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    w = min(window, n)
    edge = np.zeros(w - 1, np.uint64)
    high = of_windows(np.maximum, np.concatenate([edge, of_windows(np.minimum, g, w), edge]), w)
    take = high == g
    again = np.zeros(n, bool)
    again[1:] = g[1:] == g[:-1]
    second = again.copy()
    second[1:] &= ~again[:-1]
    at = np.flatnonzero(take & ~again | second)  # a run of one k-mer is two seeds, its start and a mark that it goes on
    g = np.where(second[at], ~g[at], g[at])
    first = np.zeros(len(at), bool)
    first[np.unique(g, return_index=True)[1]] = True
    return g, at, first


def run_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of that many words, by its start."""
    n = len(h) - words + 1
    g = np.zeros(max(n, 0), np.uint64)
    for i in range(words if n > 0 else 0):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(29))


def open_runs(at: np.ndarray, spans: list[tuple[int, int]], words: int, k: int, window: int) -> np.ndarray:
    """Starts of runs of that many words that may repeat elsewhere, and that no span (start, end) covers.

    `at` holds the positions of the shared seeds. Such a run has its seeds in common from its window-th k-mer to the
    window-th from its end, with gaps of at most a window.
    """
    if not len(at):
        return np.empty(0, np.int64)
    at = np.unique(at.astype(np.int64))
    cut = np.flatnonzero(np.diff(at) > window) + 1
    head, tail = 2 * window - 2, words - k + 1 - 2 * window + 1  # the first such seed is at most there, the last at least
    low, high = at[np.concatenate([[0], cut])] - head, at[np.concatenate([cut - 1, [len(at) - 1]])] - tail
    low, some = np.maximum(low, 0), high >= np.maximum(low, 0)
    starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(low[some], high[some], strict=True)]) if some.any() else np.empty(0, np.int64)
    starts = np.unique(starts)
    return starts[outside(starts, words, spans)]


def mark_of(starts: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Number of the seed that stands for each run: the first behind its window-th k-mer, which all equal runs share; -1 where that is too far."""
    no = np.searchsorted(at, starts + window - 1)
    near = no < len(at)
    near[near] = at[no[near]] <= starts[near] + 2 * window - 2
    return np.where(near, no, -1)


def chains(x: np.ndarray, y: np.ndarray, k: int = K, cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Best chains of matches (x[i], y[i]), as lists of segments (x, y, words) in order; no segment is used twice.

    Matches that overlap on a diagonal are merged first. f(j) = earned(j) + max(0, max over ends before j of
    f(i) - cost * distance), where distances in x and y add up, so that a prefix maximum over y suffices:
    the Fenwick tree holds f(i) + cost * (end x + end y).
    """
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x - y) != 0) | (np.diff(x) > k)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(x)) - 1
    seg = sorted((int(a), int(b), int(n)) for a, b, n in zip(x[start], y[start], x[stop] - x[start] + k, strict=True))
    ends = sorted({b + n for _, b, n in seg})
    size = len(ends)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * len(seg), [-1] * len(seg)
    waiting: list[tuple[int, int]] = sorted((a + n, i) for i, (a, _, n) in enumerate(seg))
    done = 0
    for j, (a, b, n) in enumerate(seg):
        while done < len(waiting) and waiting[done][0] <= a:  # a segment counts once x has passed its end
            i = waiting[done][1]
            value = (score[i] + cost * (seg[i][0] + seg[i][1] + 2 * seg[i][2]), i)
            p = bisect_left(ends, seg[i][1] + seg[i][2]) + 1
            while p <= size:
                if tree[p] < value:
                    tree[p] = value
                p += p & -p
            done += 1
        best = (0.0, -1)
        p = bisect_left(ends, b + 1)
        while p:
            got = tree[p][0] - cost * (a + b)
            if got > best[0]:
                best = (got, tree[p][1])
            p -= p & -p
        score[j], back[j] = n + best[0], best[1]
    out, used = [], [False] * len(seg)
    for j in sorted(range(len(seg)), key=lambda i: -score[i]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(seg[j])
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def _common(a: np.ndarray, b: np.ndarray, spare: float) -> int:
    """Words that the best alignment of a and b matches, if all but `spare` words of the longer one match; else at most that many.

    Such an alignment leaves the diagonal by at most `spare`, so rows are computed within that band only.
    """
    if not len(a) or not len(b):
        return 0
    same = int((a == b).sum()) if len(a) == len(b) else 0
    if len(a) < len(b):
        a, b = b, a
    wide = int(spare) + 1
    if same >= len(a) - 1 or len(a) - len(b) > wide:
        return same
    row = np.zeros(len(b) + 1, np.int64)
    for i, w in enumerate(a):  # longest common subsequence, a row at a time
        lo, hi = max(i - wide, 0), min(i + wide + 1, len(b))
        if lo >= hi:
            continue
        step = np.maximum(row[lo + 1 : hi + 1], row[lo:hi] + (b[lo:hi] == w))
        row[lo + 1 : hi + 1] = np.maximum(np.maximum.accumulate(step), row[lo])
        if hi < len(b):
            row[hi + 1] = max(row[hi + 1], row[hi])
    return int(row[-1])


def _reach(a: np.ndarray, b: np.ndarray, drop: int = 6) -> tuple[int, int]:
    """(words, matches) by which two texts go on alike: the best total of +1 and -1 before it falls by drop."""
    n = min(len(a), len(b))
    at, total, best, words, hits, seen = 0, 0, 0, 0, 0, 0
    while at < n:
        same = a[at : min(n, at + 128)] == b[at : min(n, at + 128)]
        run = total + np.cumsum(np.where(same, 1, -1))
        top = np.maximum.accumulate(np.maximum(run, best))
        bad = np.flatnonzero(run <= top - drop)
        stop = int(bad[0]) if len(bad) else len(run)
        if stop:
            i = int(run[:stop].argmax())
            if run[i] > best:
                best, words, hits = int(run[i]), at + i + 1, seen + int(same[: i + 1].sum())
        if len(bad):
            break
        total, seen, at = int(run[-1]), seen + int(same.sum()), at + len(same)
    return words, hits


def aligned(path: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, least_words: int = LEAST_WORDS, least_similar: float = LEAST_SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end in a, start, end in b, similarity) of a chain; a gap that would make it too unlike splits it."""
    pieces: list[list[int]] = []  # start a, end a, start b, end b, matches
    for x, y, n in path:
        same = int((a[x : x + n] == b[y : y + n]).sum())
        if pieces:
            p = pieces[-1]
            gap = max(x - p[1], y - p[3])
            spare = 0.5 * max(p[4], 8)
            inner = _common(a[p[1] : x], b[p[3] : y], spare)
            hits = p[4] + inner + same
            if gap - inner <= spare and hits >= least_similar * max(x + n - p[0], y + n - p[2]):
                pieces[-1] = [p[0], x + n, p[2], y + n, hits]
                continue
        pieces.append([x, x + n, y, y + n, same])
    out = []
    for s, e, t, u, hits in pieces:
        left, lh = _reach(a[:s][::-1], b[:t][::-1])
        right, rh = _reach(a[e:], b[u:])
        s, t, e, u, hits = s - left, t - left, e + right, u + right, hits + lh + rh
        like = hits / max(e - s, u - t)
        if min(e - s, u - t) >= least_words and like >= least_similar:
            out.append((s, e, t, u, like))
    return out


def held(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions, ascending, and seeds of each row of a list of structs (pos, seed)."""
    for row in column:
        pos, seed = (row.values.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "seed"))
        order = np.lexsort((seed, pos))
        yield pos[order].astype(np.int64), seed[order]


def outside(starts: np.ndarray, words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether no span (start, end) covers the words from each of the sorted starts."""
    left = np.ones(len(starts), bool)
    for x, y in spans:
        low = np.searchsorted(starts, x)
        left[low : max(np.searchsorted(starts, y - words, "right"), low)] = False
    return left


def seed_pairs(pos: np.ndarray, seed: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and numbers (i, j) of the seeds of each two that lie low to high words apart; pos is sorted."""
    first, last = np.searchsorted(pos, pos + low), np.searchsorted(pos, pos + high, "right")
    n = last - first
    i = np.repeat(np.arange(len(pos)), n)
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    a, b = seed[i].view(np.uint64), seed[j].view(np.uint64)
    g = (a * np.uint64(0x9E3779B97F4A7C15) ^ (a >> np.uint64(29))) + b
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(29)), i, j


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_similar: float = LEAST_SIMILAR, k: int = K, window: int = WINDOW) -> DataFrame:
    """A row per passage of a document that another document repeats.

    Columns: key, start_word, end_word, other_id, other_start, other_end, n_words, similarity. Words are
    separated by ASCII white space and compared without the case of A-Z. A document may have several
    passages; what has none is absent. Copies of a text are passages like any other: each meets the anchor
    of its seeds, so a group costs a row per member and not its pairs. Null and empty texts and rows with
    a null key take no part; repeated rows count once; rows that repeat a key with other texts are documents of their own,
    whose passages all carry the key (other_id is the key itself where two texts of one key share a passage).
    Of a stretch of one repeated word, as many words count as the other document has. An empty table gives no row.
    """
    src = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    n_rows, n_keys = docs.where(F.col(key).isNotNull()).agg(F.count(key), F.count_distinct(key)).first()
    if n_rows != n_keys:  # texts are then named by a hash of the row
        named = src.withColumn("id", F.xxhash64("doc", "text"))
        names = stored(named.select("id", "doc").distinct(), "names")
        got = repeated_passages(named.select("id", "text").dropDuplicates(["id"]), "id", "text", least_words, least_similar, k, window)
        got = got.join(names, "id").join(names.select(F.col("id").alias("other_id"), F.col("doc").alias("other")), "other_id")
        return got.select(F.col("doc").alias(key), "start_word", "end_word", F.col("other").alias("other_id"), "other_start", "other_end", "n_words", "similarity").distinct()
    kind = src.schema["doc"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in pieces(batches):
            if len(known) > 200_000:
                known.clear()
            rows = [i for i, t in enumerate(b.column(1).to_pylist()) if t]
            done = [seeds(word_hashes(b.column(1)[i].as_py(), known), k, window) for i in rows]
            if not done:
                continue
            g, p, f = (np.concatenate(c) for c in zip(*done, strict=True))
            of = b.column(0).take(pa.array(np.repeat(rows, [len(x) for _, x, _ in done])))
            yield pa.RecordBatch.from_arrays([of, pa.array(g.view(np.int64)), pa.array(p.astype(np.int32)), pa.array(f)], ["doc", "seed", "pos", "first"])

    found = stored(src.mapInArrow(find, f"doc {kind}, seed long, pos int, first boolean"), "seeds")
    shared = found.where("first").groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z")
    hits = stored(found.join(stored(shared, "shared"), "seed"), "hits")
    other = F.when(F.col("doc") == F.col("a"), F.col("z")).otherwise(F.col("a"))
    at = hits.where("first and doc in (a, z)").select("seed", F.col("doc").alias("other"), F.col("pos").alias("at"))
    matches = hits.select("doc", "seed", "pos", other.alias("other")).join(stored(at, "at"), ["seed", "other"]).select("doc", "pos", "other", "at")

    def chain(batches: Iterator[pa.RecordBatch], k: int = k, alone: bool = False) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, other, y = (t.column(c).to_numpy() for c in ("doc", "other", "at"))
            if alone:  # all starts of a run in one row
                lists = t.column("pos").combine_chunks()
                of = pc.list_parent_indices(lists).to_numpy()
                doc, other, x, y = doc[of], other[of], lists.flatten().to_numpy(), y[of]
            else:
                x = t.column("pos").to_numpy()
            x, y = x.astype(np.int64), y.astype(np.int64)
            cuts = [0, *(np.flatnonzero((doc[1:] != doc[:-1]) | (other[1:] != other[:-1])) + 1).tolist(), len(doc)]
            rows: list[tuple] = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e - s < 2 and not alone:  # one seed of k words is seldom all that a passage has in common with another
                    continue
                paths = [[v for seg in path for v in seg] for path in chains(x[s:e], y[s:e], k) if alone or len(path) > 1 or path[0][2] > k]
                if paths:
                    rows.append((doc[s], other[s], paths))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], t.schema.field("doc").type), pa.array([r[1] for r in rows], t.schema.field("other").type),
                     pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))], ["doc", "other", "paths"])

        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            if t.num_rows < 2:
                left = t
                continue
            doc, other = t.column("doc").to_numpy(), t.column("other").to_numpy()
            new = np.flatnonzero((doc[1:] != doc[:-1]) | (other[1:] != other[:-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield from work(t.slice(0, cut))
            left = t.slice(cut).combine_chunks()
        if left is not None:
            yield from work(left)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chained(matches: DataFrame, chain: Callable) -> DataFrame:
        dealt = matches.repartition(n, "doc", "other").sortWithinPartitions("doc", "other", "at")
        return stored(dealt.mapInArrow(chain, f"doc {kind}, other {kind}, paths array<array<int>>"), "chains")

    def align(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        known, last, y = _Numbers(), None, np.empty(0, np.int64)
        for b in pieces(batches, 128):
            rows = []
            for i, (paths_, w, v) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
                if len(known) > 200_000:
                    known.clear()
                    last = None
                if v != last:  # the join leaves rows of one other text together
                    last, y = v, word_ids(open_up(v), known)
                x = word_ids(open_up(w), known)
                got: list[tuple] = []
                for path in sorted(paths_) if once else paths_:
                    segs = [tuple(path[j : j + 3]) for j in range(0, len(path), 3)]
                    if once and any(p[0] <= segs[0][0] and segs[-1][0] + segs[-1][2] <= p[1] for p in got):  # periodic words: a run at every period
                        continue
                    if max(s[0] + s[2] for s in segs) <= len(x) and max(s[1] + s[2] for s in segs) <= len(y):  # else seeds of another text of the key
                        got += aligned(segs, x, y, least_words, least_similar)
                rows += [(i, *p) for p in got]
            if rows:
                i, s, e, t, u, like = zip(*rows, strict=True)
                at_ = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at_), b.column(1).take(at_), *[pa.array(c, pa.int64()) for c in (s, e, t, u)], pa.array(like, pa.float64())],
                    ["doc", "other", "s", "e", "t", "u", "like"])

    def passages(paths: DataFrame, words: DataFrame, once: bool = False) -> DataFrame:
        both = paths.join(words.withColumnRenamed("words", "w"), "doc").join(words.select(F.col("doc").alias("other"), F.col("words").alias("v")), "other")
        return stored(both.select("doc", "other", "paths", "w", "v").mapInArrow(lambda batches: align(batches, once), f"doc {kind}, other {kind}, s long, e long, t long, u long, like double").distinct(), "passages")

    # shared seeds of a document in one row, as long as its text; and whether it has a long enough stretch of them
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            long = pa.array([len(open_runs(p, [], least_words, k, window)) > 0 for p, _ in held(b.column(1))], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, long], ["doc", "at", "long"])

    listed = "at array<struct<pos:int,seed:long>>"
    marks = hits.groupBy("doc").agg(F.collect_set(F.struct("pos", "seed")).alias("at"))
    marks = stored(marks.mapInArrow(stretches, f"doc {kind}, {listed}, long boolean"), "marks")

    def holding(seeds: DataFrame) -> DataFrame:
        """(doc, pos, seed) of the shared seeds that a filter of the given ones lets through, so that few rows meet them."""
        bits = filter_bits(seeds.count())
        filter_ = bloom(seeds.select(F.col("seed").alias("key")), bits)

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                flat = b.column(1).flatten()
                ok = pa.array(in_bloom(filter_, bits, flat.field("seed").to_numpy(zero_copy_only=False)))
                of = pc.list_parent_indices(b.column(1)).filter(ok)
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), flat.field("pos").filter(ok), flat.field("seed").filter(ok)], ["doc", "pos", "seed"])

        return marks.select("doc", "at").mapInArrow(some, f"doc {kind}, pos int, seed long")

    stretched = marks.where("long").drop("long")
    paths = chained(matches, chain)

    def spelled(wanted: DataFrame) -> DataFrame:
        """The compressed words of the wanted documents (d); the filter's bits are fixed, a false positive is only extra work."""
        filter_ = bloom(wanted.select(F.xxhash64("d").alias("key")), FILTER_BITS)

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=3).compress
            for b in batches:
                some = b.filter(pa.array(in_bloom(filter_, FILTER_BITS, b.column(2).to_numpy())))
                for part in pieces(iter([some])):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([squeeze((t or "").encode().lower()) for t in part.column(1).to_pylist()], pa.binary())], ["doc", "words"])

        words = stored(src.select("doc", "text", F.xxhash64("doc").alias("key")).mapInArrow(spell, f"doc {kind}, words binary"), "words")
        n_words, n_docs = words.agg(F.count("doc"), F.count_distinct("doc")).first()
        if n_words != n_docs:  # a key on several rows: one text of each, the same in every run
            words = stored(words.groupBy("doc").agg(F.min("words").alias("words")), "words")
        return words

    ends_of = lambda df: df.select(F.explode(F.array("doc", "other")).alias("d"))
    words = spelled(ends_of(paths).union(stretched.select("doc")).distinct())
    got = passages(paths, words)

    # second round: runs that no passage covers, named by a seed and the distance from the start of the run to it
    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            made = [np.empty((0, 2), np.int64)]
            for (pos, seed), spans in zip(held(b.column(1)), b.column(2).to_pylist(), strict=True):
                p, first, n = np.unique(pos, return_index=True, return_counts=True)
                starts = open_runs(p, [(x["s"], x["e"]) for x in spans or []], least_words, k, window)
                no = mark_of(starts, p, window)
                starts, no = starts[no >= 0], no[no >= 0]
                for more in range(int(n.max(initial=0))):  # a key on several rows may have several seeds at a place
                    has = n[no] > more
                    made.append(np.stack([seed[first[no[has]] + more], p[no[has]] - starts[has]], 1))
            made = np.unique(np.concatenate(made), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].astype(np.int32))], ["seed", "back"])

    spans_of = lambda got: got.groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = stored(spans_of(got), "spans")
    bare = stretched.join(spans, "doc", "left").mapInArrow(uncovered, "seed long, back int")
    # a seed with its few distances in one row, so that each occurrence of a frequent seed stays one row
    asked = bare.groupBy("seed").agg(F.collect_set("back").alias("backs"))
    here = F.transform("backs", lambda b: F.col("pos") - b)
    asked = stored(asked, "asked")
    starts = holding(asked).join(asked, "seed").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list(here))).alias("starts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per run of a document: where it stands first, and its starts that no passage covers."""
        known, open_up = _Hashes(), zstandard.ZstdDecompressor().decompress
        for b in pieces(batches, 128):
            if len(known) > 200_000:
                known.clear()
            of, g_, at_, open_, size = [], [], [], [], []
            for i, (at, packed, spans) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                h = np.fromiter(map(known.__getitem__, open_up(packed).split()), np.uint64)
                at = np.unique(np.array(at))
                at = at[(at >= 0) & (at <= len(h) - least_words)]
                if not len(at):
                    continue
                g, first, no = np.unique(run_hashes(h, least_words)[at], return_index=True, return_inverse=True)
                left = np.flatnonzero(outside(at, least_words, [(x["s"], x["e"]) for x in spans or []]))
                left = left[np.argsort(no[left], kind="stable")]
                of.append(np.full(len(g), i))
                g_.append(g)
                at_.append(at[first])
                open_.append(at[left])
                size.append(np.bincount(no[left], minlength=len(g)))
            if of:
                ends = np.concatenate([[0], np.cumsum(np.concatenate(size))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(open_).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.concatenate(of))), pa.array(np.concatenate(g_).view(np.int64)), pa.array(np.concatenate(at_).astype(np.int32)), lists],
                    ["doc", "seed", "at", "open"])

    runs = stored(starts.join(words, "doc").join(spans, "doc", "left").mapInArrow(whole, f"doc {kind}, seed long, at int, open array<int>"), "runs")
    ends = stored(runs.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z"), "ends")
    missed = stored(runs.where("size(open) > 0").join(ends, "seed").select("doc", "seed", F.col("open").alias("pos"), other.alias("other")), "missed")
    at = missed.select("seed", "other").distinct().join(runs.select("seed", F.col("doc").alias("other"), "at"), ["seed", "other"])
    again = missed.join(at, ["seed", "other"]).select("doc", "pos", "other", "at")
    got = got.union(passages(chained(again, lambda batches: chain(batches, least_words, True)), words, True))

    # third round: pairs of seeds that no passage covers, of which an anchor has to hold both
    low, high = k, least_words - k
    spans = stored(spans_of(got), "spans")

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            some = [np.empty(0, np.int64)]
            for (pos, seed), spans in zip(held(b.column(1)), b.column(2).to_pylist(), strict=True):
                left = outside(pos, k, [(x["s"], x["e"]) for x in spans or []])
                pos, seed = pos[left], seed[left]
                _, i, j = seed_pairs(pos, seed, low, high)
                some.append(seed[np.union1d(i, j)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(some)))], ["seed"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per distinct pair of seeds of a document, at its first place that no passage covers or, failing that, its first; near counts the seeds around."""
        for b in pieces(batches):
            of, rows = [], [np.empty((0, 5), np.int64)]
            for n, ((pos, seed), spans) in enumerate(zip(held(b.column(1)), b.column(2).to_pylist(), strict=True)):
                left = outside(pos, k, [(x["s"], x["e"]) for x in spans or []])
                g, i, j = seed_pairs(pos, seed, low, high)
                bare = left[i] & left[j]
                order = np.lexsort((~bare, g))
                g, i, j, bare = g[order], i[order], j[order], bare[order]
                new = np.ones(len(g), bool)
                new[1:] = g[1:] != g[:-1]
                x, y = pos[i[new]], pos[j[new]]
                near = np.searchsorted(pos, y + high, "right") - np.searchsorted(pos, x - high)
                rows.append(np.stack([g[new].view(np.int64), x, y, bare[new], near], 1))
                of += [n] * int(new.sum())
            r = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of, pa.int64())), pa.array(r[:, 0].copy()), pa.array(r[:, 1].astype(np.int32)), pa.array(r[:, 2].astype(np.int32)), pa.array(r[:, 3] > 0), pa.array(r[:, 4].astype(np.int32))],
                ["doc", "seed", "p", "q", "open", "near"])

    loose = stored(marks.drop("long").join(spans, "doc", "left").mapInArrow(free, "seed long").distinct(), "loose")
    both = holding(loose).join(loose, "seed").groupBy("doc").agg(F.collect_set(F.struct("pos", "seed")).alias("at")).join(spans, "doc", "left")
    pairs = stored(both.mapInArrow(paired, f"doc {kind}, seed long, p int, q int, open boolean, near int"), "pairs")
    # the anchors are the two documents with the most such seeds around: fragments have few
    most = lambda name: F.max_by("doc", F.struct("near", "doc")).alias(name)
    best = stored(pairs.groupBy("seed").agg(most("a"), F.max("open").alias("any"), F.count("doc").alias("n")).where("any and n > 1").select("seed", "a"), "best")
    ends = best.join(pairs.join(best, "seed").where("doc != a").groupBy("seed").agg(most("z")), "seed")
    found = pairs.join(stored(ends, "ends"), "seed")
    anchors = found.where("doc in (a, z)").select("seed", F.col("doc").alias("other"), F.col("p").alias("pa"), F.col("q").alias("qa"))
    new = found.where("open").select("doc", "seed", "p", "q", other.alias("other")).join(paths.select("doc", "other"), ["doc", "other"], "left_anti")
    near = new.join(stored(anchors, "anchors"), ["seed", "other"]).select(
        "doc", "other", F.explode(F.array(F.struct(F.col("p").alias("pos"), F.col("pa").alias("at")), F.struct(F.col("q").alias("pos"), F.col("qa").alias("at")))).alias("m"))
    paths = chained(near.select("doc", "m.pos", "other", "m.at").distinct(), chain)
    got = got.union(passages(paths, spelled(ends_of(paths).distinct()))).distinct()
    return got.select(F.col("doc").alias(key), F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("other").alias("other_id"), F.col("t").alias("other_start"), F.col("u").alias("other_end"), (F.col("e") - F.col("s")).alias("n_words"), F.col("like").alias("similarity"))
