"""Periodic runs of words: Lyndon roots from the grouping phase of a suffix sorter, extended to runs.

Phase one of Baier's suffix sorter puts suffixes into ordered groups by their longest Lyndon prefix. Groups
are taken from the greatest down; when one is taken, its suffixes leave a linked list of open positions, and
the open position left of each (its nearest suffix of a lower group) takes the group's prefix as often as it
was met, into a new group right above its old one. The length of a position's prefix is its entry in the Lyndon
array, so one pass under the order of words and one under the reverse give both arrays, and no suffix array is made.
Every run has a Lyndon root in one of the two; longest common extensions to both sides make the run of it.

Words that cannot lie in a run are set aside first, exactly: a run of period q repeats grams within q words over
a stretch of the text, so only stretches of near repeats (and the words before them they repeat) are grouped. The
extensions then run over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import give_back, pieces

GRAM = 4  # words of a gram, for periods above 2
CHUNK = 1 << 22  # bytes of text that are held as words at a time, beside one longer text
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon(s: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position of s, whose values are 0 .. max(s)."""
    n = len(s)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    members: list[list[int]] = [[] for _ in range(max(s) + 1)] if n else []
    for i, c in enumerate(s):
        members[c].append(i)
    group, length = list(s), [1] * n
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    g = len(members) - 1
    while g >= 0:
        met: list[int] = []  # open positions left of the group's suffixes
        times: list[int] = []
        size = 0
        for i in members[g]:
            if group[i] != g:
                continue  # went to a group above
            size = length[i]
            group[i] = -1
            p, q = left[i], right[i]
            if q < n:
                left[q] = p
            if p >= 0:
                right[p] = q
                if met and met[-1] == p:
                    times[-1] += 1
                else:
                    met.append(p)
                    times.append(1)
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in zip(met, times, strict=True):
            moved.setdefault((group[p], -k), []).append(p)
        for h, k in sorted(moved):  # of one old group, the one met most often is put in first and ends on top
            new, those = len(members), moved[h, k]
            members.append(those)
            for p in those:
                group[p] = new
                length[p] -= k * size
            above = upper[h]  # g at most
            lower.append(h)
            upper.append(above)
            upper[h] = lower[above] = new
        members[g] = []
        g = lower[g]
    return length


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _MIX | np.uint64(1), np.uint64)]))


def extensions(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the suffixes at i and at j > i, found by prefix hashes; never too short."""
    n = len(ids)
    power = _powers(n)
    code = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(29)
    hashed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:n])])
    low, high = np.zeros(len(i), np.int64), n - j
    while True:
        on = low < high
        if not on.any():
            return low
        mid = (low + high + 1) // 2
        same = (hashed[i + mid] - hashed[i]) * power[j - i] == hashed[j + mid] - hashed[j]
        low, high = np.where(on & same, mid, low), np.where(on & ~same, mid - 1, high)


def _scan(ids: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The stretch of period p around [i, i + p), word by word."""
    differ = np.flatnonzero(ids[:-p] != ids[p:])
    at = np.searchsorted(differ, i)
    start = int(differ[at - 1]) + 1 if at else 0
    end = int(differ[at]) + p if at < len(differ) else len(ids)
    return start, end


def roots(ids: np.ndarray, a: int, b: int) -> np.ndarray:
    """(position, period) of the Lyndon words of ids[a:b] under both orders."""
    _, s = np.unique(ids[a:b], return_inverse=True)
    top = int(s.max())
    both = np.concatenate([lyndon(s.tolist()), lyndon((top - s).tolist())])
    at = np.tile(np.arange(a, b), 2)
    fit = at + both < b  # a run goes on behind its root
    pairs = np.unique(at[fit] * (b + 1) + both[fit])
    return np.stack([pairs // (b + 1), pairs % (b + 1)], 1)


def maximal(ids: np.ndarray, windows: list[tuple[int, int]], exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that lie in one of the windows, by start, then period."""
    found = [roots(ids, a, b) for a, b in windows]
    if not found:
        return []
    i, p = np.concatenate(found).T
    after = extensions(ids, i, i + p)
    back = ids[::-1]
    n = len(ids)
    before = extensions(back, n - i - p, n - i)  # words left of i and of i + p
    start, end = i - before, i + p + after
    good = end - start >= np.maximum(least, exponent * p)
    by: dict[tuple[int, int, int], list[int]] = {}
    for at, *run in zip(i[good].tolist(), start[good].tolist(), end[good].tolist(), p[good].tolist(), strict=True):
        by.setdefault(tuple(run), []).append(at)
    out = set()
    for (s, e, q), those in by.items():
        if np.array_equal(ids[s : e - q], ids[s + q : e]):
            out.add((s, e - s, q))
            continue
        for x, y in {_scan(ids, at, q) for at in those}:  # two hashes were equal by chance
            if y - x >= max(least, exponent * q):
                out.add((x, y - x, q))
    return sorted(out)


def stretches(ids: np.ndarray, first: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of the words outside of which no run has a word.

    ids are the words of several texts one after the other, different between texts; first holds the starts of
    the texts. For periods of (h, 2h] and the nearest earlier occurrence of each gram, a run leaves a stretch of repeats within 2h.
    """
    n = len(ids)
    gaps = {}
    for g in (1, GRAM):
        if n < g:
            continue
        code = ids[: n - g + 1].astype(np.uint64)
        for k in range(1, g):
            code = code * (_MIX | np.uint64(1)) + ids[k : n - g + 1 + k].astype(np.uint64)
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        gap = np.full(len(code), n + 1, np.int64)
        gap[order[1:][same]] = order[1:][same] - order[:-1][same]
        gaps[g] = gap
    longest = int(np.diff(np.append(first, n)).max()) if len(first) else 0
    out, h = [], 0  # periods of (h, top]
    while exponent * (h + 1) <= longest:
        top = 2 * h or 1
        q = h + 1
        g = GRAM if (exponent - 1) * q >= 2 * GRAM else 1
        need = max(least, exponent * q) - q - g + 1
        if g in gaps:
            near = np.concatenate([[0], (gaps[g] <= top).view(np.int8), [0]])
            edge = np.flatnonzero(np.diff(near)).reshape(-1, 2)
            for a, b in edge[edge[:, 1] - edge[:, 0] >= need].tolist():
                text = first[np.searchsorted(first, a, "right") - 1]
                out.append((max(int(text), a - top), b + g - 1))
        h = top
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:  # windows of two texts can touch, never overlap
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(texts: list[list[bytes]], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words: (start, length, period) with length >= max(least, exponent * period)."""
    ids, first, base = [], [], 0
    at = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)
        if words:
            first.append(at)
        at += len(words)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    starts = np.array(first, np.int64)
    spans: dict[int, list[tuple[int, int]]] = {}
    for a, b in merged(stretches(flat, starts, exponent, least)) if len(flat) else []:
        spans.setdefault(int(starts[np.searchsorted(starts, a, "right") - 1]), []).append((a, b))
    out, at = [], 0
    for words, own in zip(texts, ids, strict=True):
        mine = [(a - at, b - at) for a, b in spans.get(at, [])] if len(words) else []
        out.append(maximal(own, mine, exponent, least))
        at += len(words)
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds behind its first period, joined by one space."""
    if found:
        keep = np.ones(len(words), bool)
        for start, length, q in found:
            keep[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """key, runs (array of start, length, period by start, then period) and collapsed (the text without repeats) of every row.

    Words are what ASCII white space separates, numbered from 0. A null or empty text has no words, no runs and an
    empty collapsed text. Rows that repeat a key are rows of their own, null keys stay; texts of any length are taken whole, and
    long ones are worked on one at a time. An empty table gives no row, other columns are ignored. exponent is at least 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

        def work(keys: list, texts: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
            found = runs_of(texts, exponent, least)
            flat = [r for rs in found for r in rs]
            spans = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], fields=list(item))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            left = pa.array([collapsed(w, rs) for w, rs in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(ends), spans), left], ["key", "runs", "collapsed"])

        for b in pieces(batches):
            keys, texts, held = [], [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or "").encode().split()
                keys.append(k)
                texts.append(words)
                held += len(t or "") + 50 * len(words)
                if held > CHUNK:
                    yield work(keys, texts, b.schema.field(0).type)
                    keys, texts, held = [], [], 0
            if keys:
                yield work(keys, texts, b.schema.field(0).type)
        give_back()

    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    out = src.mapInArrow(run, f"key {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("key", key)
