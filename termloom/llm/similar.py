"""Near duplicates by similarity: SimHash candidates from several seeds, verified by exact Jaccard of word shingles.

Texts with a Jaccard similarity of 0.8 differ in about 10 of 64 bits, so no one fingerprint finds them. Each
text gets SEEDS independent fingerprints; texts that agree in one block of 16 bits of a fingerprint form a cell, with
a BK-tree over its distinct fingerprints whose edges within RADIUS are followed. What a tree finds is held against all
fingerprints (`farthest`) and the sizes of both shingle sets before it leaves the task, then verified on the texts. In
a first round every text meets its closest candidate of a cell; the second takes what the first has not linked, among
texts that had a candidate, by WIDE fingerprints each, so a group of near copies costs rows and few pairs, and no
candidate goes unverified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import components, give_back, grid_cells, pieces, stored
from termloom.llm.secrets import bloom, filter_bits, in_bloom
from termloom.llm.simhash import Forest

SEEDS = 10
BLOCK = 16
RADIUS = 12  # of 64 bits
CARRIED = 4  # fingerprints that a text takes into a cell in the first round
WIDE = 64  # fingerprints in the second round
SHORT = 16  # shingles: sums of few bits tie often, so these texts may differ in more bits
CELL_MOST = 4_096
_STEPS = (np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def farthest(bits: int, least: float, short: bool) -> int:
    """Differing bits beyond which a pair is no candidate: five deviations above the mean of pairs of that similarity."""
    share = np.arccos(2 * least / (1 + least)) / np.pi  # 0.15 of the bits at 0.8
    return int(bits * (0.28 if short else share) + (0 if short else 5) * np.sqrt(bits * share * (1 - share)))


def shingles(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words none."""
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(flat[a:b]) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def sketch(h: np.ndarray, seeds: int = SEEDS) -> np.ndarray:
    """SimHash fingerprints of a set of shingle hashes, the first ones the same for every number of seeds."""
    ones = np.zeros(64 * seeds, np.int64)
    for at in range(0, len(h), 2_048):
        g = h[at : at + 2_048, None] + _STEPS[:, :seeds]
        g ^= g >> np.uint64(30)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(27)
        g *= np.uint64(0x94D049BB133111EB)
        g ^= g >> np.uint64(31)
        ones += np.unpackbits(g.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays without repeats; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, node, size, fps): node is the hash of the shingle set of that size, fps is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            node, size, fps = [], [], []
            for t in b.column(1).to_pylist():
                h = shingles(t.encode().lower().split() if t else [], shingle)
                node.append(xxhash.xxh64_intdigest(h.tobytes()))
                size.append(len(h))
                fps.append(sketch(h).view(np.int64) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(fps, pa.list_(pa.int64()))], ["key", "node", "size", "fps"])
        give_back()

    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, node long, size int, fps array<long>")


def tree_hits(cell: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of rows of one cell whose fingerprints differ in at most radius bits.

    Rows are sorted by cell, then fingerprint. Rows with equal ones are one point of the cell's tree.
    """
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(cell)))
    forest = Forest(fp[start], cell[start])
    _, first, of, size = np.unique(cell[start], return_index=True, return_inverse=True, return_counts=True)
    part = np.cumsum(size[of]) // 500_000  # bounds the walk's frontier
    for asked in np.split(np.arange(len(start)), np.flatnonzero(np.diff(part)) + 1):
        asked = asked[(size[of[asked]] > 1) | (count[asked] > 1)]
        met: list[tuple[np.ndarray, np.ndarray]] = []
        if len(asked):
            forest.near(fp[start[asked]], cell[start[asked]], radius, lambda q, p, a=asked, m=met: m.append((a[q], p)))
        for p, q in met:
            ahead = p <= q
            p, q = p[ahead], q[ahead]
            pairs = count[p] * count[q]
            for some in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(pairs) // 1_000_000)) + 1):
                n = pairs[some]
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                wide = np.repeat(count[q[some]], n)
                i, j = np.repeat(start[p[some]], n) + k // wide, np.repeat(start[q[some]], n) + k % wide
                yield i[i < j], j[i < j]


def cell_pairs(c: dict[str, np.ndarray], closest: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (a, b) of the candidates in some cells: all, or with `closest` for every row its closest candidate only.

    meets tells whether rows of one chunk (0 or 1, in bit 1) are compared in this cell.
    """
    node, part, meets, size, fps = c["node"], c["part"], c["meets"], c["size"], c["fps"]
    best = np.full(len(node), np.iinfo(np.int64).max)
    out = [(node[:0], node[:0])]
    for i, j in tree_hits(c["cell"], c["fp"], RADIUS):
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (part[i] != part[j]) & ((meets[i] & 1 == 1) | (meets[i] != meets[j])) & (low + 1e-9 >= least * high)
        i, j, low = i[ok], j[ok], low[ok]
        far = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64)
        bits = 64 * fps.shape[1]
        ok = far <= np.where(low > SHORT, farthest(bits, least, False), farthest(bits, least, True))
        i, j, far = i[ok], j[ok], far[ok]
        if closest:
            np.minimum.at(best, j, far << 32 | i)
            np.minimum.at(best, i, far << 32 | j)
        else:
            out.append((node[i], node[j]))
    if closest:
        at = np.flatnonzero(best != np.iinfo(np.int64).max)
        out.append((node[at], node[best[at] & 0xFFFFFFFF]))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def candidates(nodes: DataFrame, closest: bool, least: float = 0.8, most: int = CELL_MOST) -> DataFrame:
    """Pairs (a, b) of nodes (node, size, fps, part) of different parts that meet in a block of a fingerprint, each once.

    Without a column part every node is its own. The closest candidates are chosen by CARRIED fingerprints, the first being the
    cell's; for all candidates a node takes all it has.
    """
    fp = lambda i: F.element_at("fps", i % SEEDS + 1)
    own = lambda i: [F.array(*[fp(i + k) for k in range(1, CARRIED)]).alias("fps")] if closest else []
    blocks = F.array(*[F.struct(F.lit(i * 64 + s).alias("no"), F.shiftrightunsigned(fp(i), s).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int").alias("bits"), fp(i).alias("fp"), *own(i)) for i in range(SEEDS) for s in range(0, 64, BLOCK)])
    part = ["part"] if "part" in nodes.columns else []
    x = nodes.select("node", *part, "size", "fps", F.explode(blocks).alias("_b")).select("node", *part, "size", "_b.*", *([] if closest else ["fps"]))
    x = grid_cells(x, ["no", "bits"], F.xxhash64("node"), most)
    meets = F.when(F.col("_i") == F.col("_j"), 1).when(F.col("_c") == F.col("_i"), 0).otherwise(2)
    x = x.select(F.xxhash64("no", "bits", "_i", "_j").alias("cell"), "fp", "node", *part, (F.col("size").cast("long") * 4 + meets).alias("tag"), "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            c = {name: t.column(name).to_numpy() for name in t.column_names if name != "fps"}
            c["fp"] = c["fp"].view(np.uint64)
            c["fps"] = t.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
            if closest:
                c["fps"] = np.concatenate([c["fp"][:, None], c["fps"]], 1)
            c |= {"size": c["tag"] >> 2, "meets": c["tag"] & 3, "part": c.get("part", c["node"])}
            pair = np.unique(np.stack(cell_pairs(c, closest, least), 1), axis=0)
            for at in range(0, len(pair), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + 100_000, k].copy()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < 50_000:
                continue
            t = pa.Table.from_batches(held)
            cell = t.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if cut:
                yield from work(t.slice(0, cut))
                t = t.slice(cut)
            held, n = t.to_batches(), t.num_rows
        if n:
            yield from work(pa.Table.from_batches(held))

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a long, b long").distinct()


def spelled(nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, words): the compressed text of every node (node, rep).

    Texts are compressed before they are moved, and only those whose key passes a Bloom filter of the named keys; a
    false positive is only extra work, which the join drops.
    """
    one = nodes.select("node", F.col("rep").alias("key"))
    bits = filter_bits(one.count())
    filter_ = bloom(one.select(F.xxhash64("key").alias("key")), bits)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for part in pieces(iter([b.filter(pa.array(in_bloom(filter_, bits, b.column(2).to_numpy())))])):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack((t or "").encode().lower()) for t in part.column(1).to_pylist()], pa.binary())], ["key", "words"])

    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(key).alias("_h"))
    # rows that are equal in their key are equal in their text here, or one of them names the node
    found = src.mapInArrow(squeeze, f"key {src.schema['key'].dataType.simpleString()}, words binary").join(one, "key")
    return found.groupBy("node").agg(F.min("words").alias("words"))


def widened(words: DataFrame, shingle: int) -> DataFrame:
    """(node, fps): WIDE fingerprints of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        for b in pieces(batches, 256):
            fps = [sketch(shingles(open_up(w).split(), shingle), WIDE).view(np.int64) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], ["node", "fps"])
        give_back()

    return words.select("node", "words").mapInArrow(run, "node long, fps array<long>")


def verified(near: DataFrame, words: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have a Jaccard similarity of at least least."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        for b in pieces(batches, 128):
            ok = [jaccard(*(shingles(open_up(w).split(), shingle) for w in pair)) >= least for pair in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
        give_back()

    with_words = near.join(words.select(F.col("node").alias("a"), F.col("words").alias("v")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("w")), "b")
    return with_words.select("a", "b", "v", "w").mapInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """key and component_id (smallest key that links of at least that similarity reach) of every row; keys are not null.

    Texts with equal shingle sets are one node; null, empty and blank texts have none and are equal. A text of fewer words
    than a shingle is one shingle. Rows that repeat a key repeat its text (name rows by more than the key otherwise). Texts
    are taken whole whatever their length, only the two named columns are looked at, an empty table gives no row.
    """
    rows = stored(sketches(docs, key, text, shingle), "sketches")
    nodes = stored(rows.groupBy("node").agg(F.min("key").alias("rep"), F.first("size").alias("size"), F.first("fps").alias("fps")), "nodes")
    full = nodes.where("fps is not null")
    close = stored(candidates(full, True, least), "close")
    # the others have no candidate at all; written, so that Spark knows its size before it moves any text
    met = stored(full.join(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "met")
    words = stored(spelled(met, docs, key, text), "words")
    first = stored(verified(close, words, shingle, least), "first")
    parted = met.drop("fps").join(widened(words, shingle), "node").join(components(first), "node", "left").withColumn("part", F.coalesce("component", "node"))
    rest = stored(candidates(stored(parted, "parted"), False, least), "rest")
    second = stored(verified(rest, words, shingle, least), "second")
    comp = components(first.union(second))
    named = stored(nodes.join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "named")
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.join(named.join(ids, "component").select("node", "component_id"), "node").select(F.col("key").alias(key), "component_id")
