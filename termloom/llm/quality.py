"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are trained in numpy on a bounded sample of labelled rows and flattened into arrays, which tasks
traverse for whole batches at a time. Scores depend on the text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from termloom.llm.common import give_back, pieces

TRAIN_MOST = 20_000
TREES = 80
DEPTH = 4
BINS = 64


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


UPPER = _mask(bytes(range(65, 91)))
LOWER = _mask(bytes(range(97, 123)))
DIGIT = _mask(bytes(range(48, 58)))
WIDE = _mask(bytes(range(128, 256)))
SPACE = _mask(b" \t\n\r\x0b\x0c")
STOP = _mask(b".!?")
SOFT = _mask(b",;:'\"-()")
SYMBOL = ~(UPPER | LOWER | DIGIT | WIDE | SPACE | STOP | SOFT)
CLASSES = np.stack([UPPER, LOWER, DIGIT, WIDE, SPACE, STOP, SOFT, SYMBOL]).astype(np.float64)
LETTER_BYTES = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))

FEATURES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "wide", "space", "stop", "soft", "symbol", "bang", "mean_word", "sd_word", "short_words", "long_words",
    "distinct_words", "top_word", "bare_words", "ends_letter", "ends_stop", "log_lines", "repeated_lines", "packed", "words_per_stop", "repeated_pairs",
)


def features(text: str | None, pack=zstandard.ZstdCompressor(level=1).compress) -> list[float]:
    """Statistics of a whole text; zeros for null, empty or blank ones."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, k = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, wide, space, stop, soft, symbol = (CLASSES @ counts).tolist()
    lens = np.fromiter(map(len, words), np.int64, k)
    times = Counter(words)
    ends = Counter([w[-1] for w in words])
    letters = sum(c for b, c in ends.items() if b in LETTER_BYTES)
    lines = raw.split(b"\n")
    pairs = Counter(zip(words, words[1:], strict=False)) if k > 1 else {}
    bare = raw.translate(None, LETTER_BYTES).split()
    solid = max(1.0, upper + lower + wide)
    return [
        np.log1p(n), np.log1p(k), upper / solid, lower / solid, digit / n, wide / n, space / n, stop / n, soft / n, symbol / n, counts[33] / n,
        float(lens.mean()), float(lens.std()), float((lens <= 3).mean()), float((lens >= 15).mean()),
        len(times) / k, max(times.values()) / k, len(bare) / k, letters / k, (ends[46] + ends[63]) / k,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), len(pack(raw)) / n, k / (stop + 1), 1 - len(pairs) / max(1, k - 1),
    ]


class Model(NamedTuple):
    """All trees in flat arrays; a leaf points to itself, so every walk takes `depth` steps."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            z += self.value[at]
        return 1 / (1 + np.exp(-z))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = 0.15, least: int = 20, ridge: float = 1.0) -> Model:
    """Boosted trees of the logistic loss on binned columns. Without rows the score is 0.5; with one class it stays near that class."""
    y = y.astype(np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    z = np.full(len(y), np.log(prior / (1 - prior)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(y) else []
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)]) if len(y) else np.empty((0, 0))
    base = float(z[0]) if len(z) else 0.0
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-z))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        at = np.full(len(y), roots[-1])
        level = [roots[-1]]
        for d in range(depth + 1):
            first = level[0]
            slot = at - first
            inside = (slot >= 0) & (slot < len(level))
            s, g, h = slot[inside], grad[inside], hess[inside]
            gs, hs, ns = (np.bincount(s, w, len(level)) for w in (g, h, np.ones(len(s))))
            for i, node in enumerate(level):
                nodes[node][4] = -rate * gs[i] / (hs[i] + ridge)
            if d == depth:
                break
            best = np.full(len(level), 1e-6)
            pick = np.full((len(level), 2), -1)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                wide = len(cut) + 1
                key = s * wide + binned[f][inside]
                gl, hl, nl = (np.bincount(key, w, len(level) * wide).reshape(len(level), wide).cumsum(1)[:, :-1] for w in (g, h, np.ones(len(s))))
                gain = gl**2 / (hl + ridge) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + ridge) - (gs**2 / (hs + ridge))[:, None]
                gain[(nl < least) | (ns[:, None] - nl < least)] = -1
                top = gain.argmax(1)
                better = gain[np.arange(len(level)), top] > best
                best[better] = gain[np.arange(len(level)), top][better]
                pick[better] = np.stack([np.full(len(level), f), top], 1)[better]
            grown = []
            for i, node in enumerate(level):
                if pick[i, 0] < 0:
                    continue
                f, c = pick[i]
                kid = len(nodes)
                nodes[node][:4] = [int(f), float(cuts[f][c]), kid, kid + 1]
                nodes += [[0, np.inf, kid, kid, 0.0], [0, np.inf, kid + 1, kid + 1, 0.0]]
                mine = at == node
                at[mine] = np.where(binned[f][mine] <= c, kid, kid + 1)
                grown += [kid, kid + 1]
            if not grown:
                break
            level = grown
        z += np.array([n[4] for n in nodes])[at]
    flat = np.array(nodes, np.float64).reshape(-1, 5)
    return Model(base, depth, np.array(roots, np.int64), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4])


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the key as text leaves no remainder by 5 (null keys: true)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_MOST) -> Model:
    """Train on the labelled rows that are not held out, at most `most` of them: those with the least hash of the key.

    The bound only limits what is learned from. Null labels teach nothing; several labels of one key all count.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    n = known.count()
    if n > most:  # thin out before sorting, so that no task gets `most` rows from each other one
        known = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(1.1 * most / n * (1 << 20)) + 1)
    sample = known.orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 20)), "key", "label").limit(most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "key").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    got = rows.mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got.column("label").to_numpy()
    order = np.lexsort([*x.T, y])  # rows come in any order: a fixed one makes reruns agree to the last bit
    return train(x[order], y[order])


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, to: str = "score", least: float | None = None) -> DataFrame:
    """The carried columns (all, if None) and the score, 0 to 1. With `least`, only rows that score so much.

    Every row is scored on its own whole text; null and empty texts score like a text without words.
    """
    carry = docs.columns if carry is None else carry
    src = docs.select(F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = np.array([features(t) for t in b.column(0).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            s = model.scores(x)
            out = pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s)], [*[f"c{i}" for i in range(b.num_columns - 1)], to])
            yield out if least is None else out.filter(pa.array(s >= least))
        give_back()

    schema = StructType([*src.schema.fields[1:], StructField(to, DoubleType())])
    return src.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], to)
