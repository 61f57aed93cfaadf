"""Byte-level BPE over a corpus: every distinct pre-token is encoded once, wherever it occurs.

Pre-tokens are coded against a dictionary of their block of documents (bounded by characters), so that
what is shuffled by word is one row per block and distinct word instead of one per occurrence. The words
meet on their hash, each is encoded once, its ids go back to the block, and the documents of the block
are put together from their code sequences. Neither texts nor code sequences are shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from termloom.llm.common import bucketed, give_back, pieces

# A space before a white-space character or at the end: only there does a cut before a space depend on what follows.
ODD_SPACE = regex.compile(r" (?=\s|$)")
BLOCK_CHARS = 12_000_000


@lru_cache(4)
def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table as flat bytes, starts and lengths by id."""
    ranks = rank_table(path)
    n = max(ranks.values(), default=-1) + 1
    parts = [b""] * n
    for token, i in ranks.items():
        parts[i] = token
    lens = np.fromiter(map(len, parts), np.int64, n)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The concatenated pieces flat[starts[c] : starts[c] + lens[c]] for c in codes."""
    n = lens[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(total)]


class _Block(dict):
    """Codes of the space-led chunks of a block; a new chunk is split into pre-tokens once."""

    def __init__(self, pattern: str) -> None:
        super().__init__()
        self.find = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self.ends = array("q")
        self.flat = array("q")

    def __missing__(self, chunk: str) -> int:
        words = self.words
        flat = self.flat
        core = chunk[1:] if chunk[:1] == " " else chunk
        if core.isalpha():  # one run of letters, with at most one space before it
            flat.append(words.setdefault(chunk, len(words)))
        elif core[-1:] in (".", ",") and core[:-1].isalpha():
            flat.append(words.setdefault(chunk[:-1], len(words)))
            flat.append(words.setdefault(core[-1], len(words)))
        else:
            for w in self.find(chunk):
                flat.append(words.setdefault(w, len(words)))
        self.ends.append(len(flat))
        self[chunk] = code = len(self)
        return code

    def chunks(self, text: str) -> list[str]:
        """Cut before each space that a non-space follows: the pattern always starts a pre-token there."""
        if ODD_SPACE.search(text) is None:
            parts = text.split(" ")
            return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]
        return [c for c in regex.split(r"(?=(?: \S))", text, flags=regex.V1) if c]

    def code(self, texts: list[str]) -> list[np.ndarray]:
        got = [np.fromiter(map(self.__getitem__, self.chunks(t)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        ends = np.array(self.ends)
        lens = np.diff(ends, prepend=0)
        flat = np.array(self.flat)
        return [gather(flat, ends - lens, lens, g) for g in got]


PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def squeezed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes: small ones leave the upper planes empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()) if len(x) else b""


def opened(x: bytes) -> np.ndarray:
    if not x:
        return np.empty(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths and joined bytes, both compressed."""
    return squeezed(np.fromiter(map(len, parts), np.int64, len(parts))), zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(lens: bytes, flat: bytes) -> list[bytes]:
    n = opened(lens)
    data = zstandard.ZstdDecompressor().decompress(flat)
    ends = np.cumsum(n)
    return [data[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]


def encode(docs: DataFrame, keys: list[str], text: str, ranks: str, pattern: str, block_chars: int = BLOCK_CHARS, decoded: str | None = None) -> DataFrame:
    """Encode every whole text. Returns the keys, n_tokens (long) and ids (binary: ids as little-endian unsigned 32-bit).

    With `decoded`, a column of that name has the bytes that the ids decode to, looked up as in decode().

    Null and empty texts have no tokens. Repeated rows and null or repeated keys stay rows of their own:
    a row is addressed by its block, never by key. Other columns of docs are not looked at, so clashing
    names do no harm. The cuts of _Block hold for PLAIN_PATTERN; any other pattern is applied to whole texts.

    A block's distinct words are exploded into rows by hash bucket (block, bucket, words, places); the rows
    of a bucket meet in one task, which encodes each distinct word once and sends the ids back to the block.
    Documents wait in a table bucketed by block, so that their code sequences are written once and not
    shuffled. A word has one entry per block at most, however often it occurs.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = 4 * n_parts
    simple = pattern == PLAIN_PATTERN
    src = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text"))
    key_fields = src.schema.fields[:-1]
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(key_fields))
    names = ["block", "bucket", "codes", "places", "lens", "words", *[f"k{i}" for i in range(len(keys))]]

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        block, chars = _Block(pattern), 0
        types: list[pa.DataType] = []

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = [w.encode() for w in block.words]
            if not words:
                return
            bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % n_buckets
            order = np.argsort(bucket, kind="stable")
            some, start = np.unique(bucket[order], return_index=True)
            rows = []
            for b, at in zip(some.tolist(), np.split(order, start[1:]), strict=True):
                rows.append((next_id, b, squeezed(np.diff(at, prepend=0)), *packed([words[i] for i in at.tolist()])))
            block_, bucket_, places, lens, flat = zip(*rows, strict=True)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block_, pa.int64()), pa.array(bucket_, pa.int32()), pa.nulls(n, pa.binary()), pa.array(places, pa.binary()), pa.array(lens, pa.binary()), pa.array(flat, pa.binary()), *[pa.nulls(n, t) for t in types]], names)

        for b in pieces(batches):
            types = [c.type for c in b.columns[:-1]]
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, b.num_rows)
            at = 0
            while at < b.num_rows:
                n = min(b.num_rows - at, max(1, int(np.searchsorted(np.cumsum(sizes[at:]), block_chars - chars, "right"))))
                some = texts[at : at + n]
                if simple:
                    codes = block.code(some)
                else:
                    codes = [np.array([block.words.setdefault(w, len(block.words)) for w in block.find(t)], np.int64) for t in some]
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next_id] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([squeezed(c) for c in codes], pa.binary()), none, none, none, *[c.slice(at, n) for c in b.columns[:-1]]], names)
                chars += int(sizes[at : at + n].sum())
                at += n
                if chars >= block_chars:
                    yield from dictionary()
                    next_id, block, chars = next_id + 1, _Block(pattern), 0
        if types:
            yield from dictionary()
        del block
        give_back()

    coded = src.mapInArrow(to_blocks, f"block long, bucket int, codes binary, places binary, lens binary, words binary, {kinds}")
    waiting = bucketed(coded, "bpe", n_parts, "block")

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        last, known = None, {}
        for b in batches:
            out = []
            for bucket, lens, words in zip(*(c.to_pylist() for c in b.columns[1:2] + b.columns[3:]), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                ids = []
                for w in unpacked(lens, words):
                    got = known.get(w)
                    if got is None:
                        known[w] = got = np.array(enc.encode_ordinary(w.decode()), "<u4").tobytes()
                    ids.append(got)
                flat = np.frombuffer(b"".join(ids), "<u4")
                out.append((squeezed(np.fromiter(map(len, ids), np.int64, len(ids)) // 4), squeezed(flat)))
            lens, ids = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lens, pa.binary()), pa.array(ids, pa.binary())], ["block", "places", "lens", "ids"])

    by_word = waiting.where("bucket is not null").select("block", "bucket", "places", "lens", "words").repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    back = by_word.mapInArrow(encode_words, "block long, places binary, lens binary, ids binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        places = [np.cumsum(opened(x)) for x in right.column("places").to_pylist()]
        lens_of = [opened(x) for x in right.column("lens").to_pylist()]
        flat_of = [opened(x) for x in right.column("ids").to_pylist()]
        n = sum(map(len, places))
        lens, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for p, k, f in zip(places, lens_of, flat_of, strict=True):
            lens[p] = k
            starts[p] = at + np.cumsum(k) - k
            at += len(f)
        flat = np.concatenate([*flat_of, np.empty(0, np.int64)]).astype("<u4")
        ids = [gather(flat, starts, lens, opened(x)) for x in left.column("codes").to_pylist()]
        out = [pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())]
        if decoded:
            out.append(pa.array([spelled(ranks, i) for i in ids], pa.binary()))
        give_back()
        return pa.table([*[left.column(f"k{i}") for i in range(len(keys))], *out], [*[f"k{i}" for i in range(len(keys))], "n_tokens", "ids", "decoded"][: len(keys) + len(out)])

    texts = waiting.where("bucket is null").select("block", "codes", *[f"k{i}" for i in range(len(keys))])
    out = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assemble, f"{kinds}, n_tokens long, ids binary" + (", decoded binary" if decoded else ""))
    more = [F.col("decoded").alias(decoded)] if decoded else []
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n_tokens", "ids", *more)


def spelled(ranks: str, ids: np.ndarray) -> bytes:
    """The bytes of a sequence of ids, from the token-byte table."""
    flat, starts, lens = token_bytes(ranks)
    return gather(flat, starts, lens, ids.astype(np.int64)).tobytes()


def decode(tokens: DataFrame, ranks: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that the packed ids stand for, by a lookup in the token-byte table (its size is the vocabulary's).

    Null ids decode to empty bytes; an id outside the table raises.
    """
    at = tokens.columns.index(ids)
    if to in tokens.columns:
        raise ValueError(f"column {to} exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [spelled(ranks, np.frombuffer(x or b"", "<u4")) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, to])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField(to, BinaryType())]))
