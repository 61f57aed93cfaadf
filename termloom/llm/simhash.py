"""SimHash near duplicates: fingerprints of word shingles, linked through BK-trees of shards.

Two fingerprints within r differing bits agree in at least one of r + 1 blocks of bits, so a shard holds
the distinct fingerprints with one value of one block, and no link is lost. Each shard has a BK-tree whose
children are keyed by their Hamming distance to the parent; a query follows the edges d - r .. d + r.
The trees of a task form one forest that numpy walks level by level. A tree goes to the task that holds
its queries through the shuffle; nothing is broadcast, as shards grow with the corpus. Hot shards are
dealt to cells of a grid. A shard returns a star per linked group, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import components, give_back, grid_cells, pieces, stored

TREE_MOST = 20_000
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half the shingle hashes; 0 without words."""
    if not text:
        return 0
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 4) -> DataFrame:
    """(key, fp) per row, fp being the fingerprint's bits as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["key", "fp"])
        give_back()

    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, fp long")


class Forest:
    """BK-trees over distinct fingerprints, one per group, as flat arrays."""

    def __init__(self, fp: np.ndarray, group: np.ndarray) -> None:
        self.fp, n = fp, len(fp)
        parent_key = np.full(n, -1, np.int64)
        order = np.argsort(group, kind="stable")
        at, slot = order, group[order].astype(np.int64)
        slot_key = np.full(n, -1, np.int64)
        self.root_group, first = np.unique(group, return_index=True)
        self.root = first
        while len(at):
            heads, start, of = np.unique(slot, return_index=True, return_inverse=True)
            node = at[start]
            parent_key[node] = slot_key[start]
            rest = np.ones(len(at), bool)
            rest[start] = False
            at, up = at[rest], node[of[rest]]
            slot_key = up * 65 + np.bitwise_count(fp[at] ^ fp[up]).astype(np.int64)
            o = np.argsort(slot_key, kind="stable")
            at, slot_key = at[o], slot_key[o]
            slot = slot_key
        self.child = np.argsort(parent_key, kind="stable")
        self.key = parent_key[self.child]

    def near(self, query: np.ndarray, group: np.ndarray, radius: int, unite) -> None:
        """Call unite(query positions, points) for all points within the radius in each query's tree."""
        r = np.searchsorted(self.root_group, group)
        ok = (r < len(self.root_group)) & (self.root_group[np.minimum(r, len(self.root_group) - 1)] == group)
        q, node = np.flatnonzero(ok), self.root[r[ok]]
        while len(q):
            d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                unite(q[hit], node[hit])
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 1), "left")
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            q = np.repeat(q, n)
            node = self.child[np.repeat(lo - (ends - n), n) + np.arange(total)]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the labels of a[i] and b[i] for all i; labels point to the smallest member."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link_cells(cell: np.ndarray, fp: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, smallest member) over the links within each cell."""
    label = np.arange(len(fp))
    rows = np.flatnonzero(tree)
    forest = Forest(fp[rows], cell[rows])
    size = np.bincount(cell[rows], minlength=int(cell.max()) + 1)
    asked = np.flatnonzero(query)
    part = np.cumsum(size[cell[asked]]) // 500_000  # bounds the walk's frontier
    for some in np.split(asked, np.flatnonzero(np.diff(part)) + 1) if len(asked) else []:
        forest.near(fp[some], cell[some], radius, lambda q, p, s=some: merge(label, s[q], rows[p]))
    out = np.flatnonzero(label != np.arange(len(fp)))
    return fp[out], fp[label[out]]


def shard_links(distinct: DataFrame, radius: int, most: int = TREE_MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links within the radius connect."""
    width = [64 // (radius + 1) + (i < 64 % (radius + 1)) for i in range(radius + 1)]
    start = [sum(width[:i]) for i in range(radius + 1)]
    blocks = F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("bits")) for i, (s, w) in enumerate(zip(start, width, strict=True))])
    x = distinct.select("fp", F.explode(blocks).alias("_b")).select("fp", "_b.no", "_b.bits")
    x = grid_cells(x, ["no", "bits"], F.xxhash64("fp"), most)
    x = x.select("no", "bits", "_i", "_j", F.xxhash64("no", "bits", "_i", "_j").alias("cell"), "fp", (F.col("_c") == F.col("_i")).alias("tree"), (F.col("_c") == F.col("_j")).alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def work(t: pa.Table) -> pa.RecordBatch:
            cols = [np.stack([t.column(c).to_numpy() for c in ("no", "bits", "_i", "_j")], 1)]
            new = np.ones(t.num_rows, bool)
            new[1:] = (np.diff(cols[0], axis=0) != 0).any(1)
            a, b = link_cells(np.cumsum(new) - 1, t.column("fp").to_numpy().view(np.uint64), t.column("tree").to_numpy(), t.column("query").to_numpy(), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < 50_000:
                continue
            t = pa.Table.from_batches(held)
            last = t.slice(t.num_rows - 1)
            same = np.ones(t.num_rows, bool)
            for c in ("no", "bits", "_i", "_j"):
                same &= t.column(c).to_numpy() == last.column(c)[0].as_py()
            cut = int(np.argmax(same))  # rows are sorted by cell: the last one may go on in the next batch
            if cut:
                yield work(t.slice(0, cut))
                t = t.slice(cut)
            held, n = t.to_batches(), t.num_rows
        if n:
            yield work(pa.Table.from_batches(held))

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = x.repartition(n, "cell").drop("cell").sortWithinPartitions("no", "bits", "_i", "_j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (smallest key reachable by links) of every row.

    Rows with equal fingerprints are one node, so copies cost one row each. Texts that are null or hold
    no word have fingerprint zero and are linked like any other. Null keys stay rows of their own and
    never name a component unless it has no other key (then component_id is null). Only the two named
    columns are looked at; empty tables give empty results.
    """
    fps = stored(fingerprints(docs, key, text, shingle), "fp")
    distinct = stored(fps.groupBy("fp").agg(F.min("key").alias("rep")), "distinct")
    comp = components(shard_links(distinct, radius))
    named = stored(distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "named")
    least = stored(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = stored(named.join(least, "component").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
