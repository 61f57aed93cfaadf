"""Secret scans through a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query in disjunctive form: at least one of its
clauses has all its trigrams in every text with a match. The postings of the queries' trigrams are
intersected per text, the candidate texts are verified with the regular expressions, and rules without a
mandatory trigram scan every text. Candidates reach the verifying scan as a Bloom filter of a fixed number
of bits, so no text is shuffled; a false positive only costs a verification.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from termloom.llm.common import give_back, pieces, stored


class Rule(NamedTuple):
    kind: str
    pattern: str
    any_case: bool = False
    least: int = 0  # code points of the group below
    group: int = 0


# Fixed values of the contract: kinds, patterns and least lengths of the base rules, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", False, 18),
    Rule("hex", r"[0-9a-f]{16,}", False, 16),
)
# Public formats beside the base rules.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + EXTRA

MOST_STRINGS = 64
ANY: None = None
Query = "list[frozenset[str]] | None"


def _absorb(clauses: set[frozenset[str]]) -> list[frozenset[str]]:
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _and(a, b):
    if a is ANY or b is ANY:
        return b if a is ANY else a
    out = {x | y for x, y in product(a, b)}
    return min(a, b, key=len) if len(out) > MOST_STRINGS else _absorb(out)


def _of_strings(strings: set[str]):
    grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return ANY if frozenset() in grams else _absorb(grams)


def _walk(items) -> tuple[set[str] | None, list[frozenset[str]] | None]:
    """All strings the sequence can match, lower-cased (None if not few), and its query."""
    from re import _constants as C

    query, run, whole = ANY, {""}, True

    def flush() -> None:
        nonlocal query, run
        query, run = _and(query, _of_strings(run)), {""}

    def extend(strings: set[str]) -> None:
        nonlocal run, whole
        if len(run) * len(strings) > MOST_STRINGS:
            flush()
            whole = False
        run = {a + b for a, b in product(run, strings)}

    for op, arg in items:
        strings, inner = None, ANY
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            strings = {chr(c).lower() for _, c in arg}
        elif op is C.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            elif all(q is not ANY for _, q in parts):
                inner = _absorb(set().union(*(q for _, q in parts)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            got, q = _walk(body)
            if got is not None and most == 1:
                strings = got | ({""} if least == 0 else set())
            elif least:
                inner = q
        elif op is C.AT:
            strings = {""}
        if strings is not None:
            extend(strings)
        else:
            flush()
            query, whole = _and(query, inner), False
    if whole:
        return run, _of_strings(run)
    flush()
    return None, query


def trigram_query(pattern: str):
    """Clauses of lower-cased trigrams of which one must be in any matching text, or None if there is no such demand."""
    from re import _parser

    query = _walk(_parser.parse(pattern))[1]
    if query is ANY or any(not g.isascii() for c in query for g in c):
        return ANY
    return query


def _code(gram: str) -> int:
    a, b, c = gram.encode()
    return a << 16 | b << 8 | c


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(key, gram) for each trigram of the list in each text; texts has key and text. Case of A-Z is ignored."""
    codes = [_code(g) for g in grams]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = np.zeros(1 << 24, np.uint16)
        look[codes] = np.arange(1, len(codes) + 1)
        names = np.array(grams, object)

        def of(some: list[bytes], keys: list[int]) -> pa.RecordBatch:
            flat = np.frombuffer(b"\n".join(some), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            code = flat[:-2].astype(np.uint32) << 16
            code |= flat[1:-1].astype(np.uint32) << 8
            code |= flat[2:]
            found = look[code]
            at = np.flatnonzero(found)
            pair = np.unique(np.searchsorted(ends, at, "right") * (len(codes) + 1) + found[at])
            row, gram = np.divmod(pair, len(codes) + 1)
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[row]), pa.array(names[gram - 1], pa.string())], ["key", "gram"])

        for b in pieces(batches):
            some, keys, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and len(text) > 2:
                    some.append(text.encode().lower())
                    keys.append(key)
                    size += len(some[-1])
                if size > 1_000_000:
                    yield of(some, keys)
                    some, keys, size = [], [], 0
            if some:
                yield of(some, keys)
        give_back()

    return texts.mapInArrow(run, "key long, gram string")


def candidates(index: DataFrame, queries: list[list[frozenset[str]]]) -> DataFrame:
    """Keys whose postings satisfy one of the queries; a key's postings are at most the queries' trigrams."""
    held = index.groupBy("key").agg(F.collect_set("gram").alias("grams"))
    clauses = [c for q in queries for c in q]
    meets = [reduce(lambda a, b: a & b, [F.array_contains("grams", g) for g in sorted(c)]) for c in clauses]
    return held.where(reduce(lambda a, b: a | b, meets)).select("key")


HASHES = 3


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the keys; what reaches the driver is at most bits / 64 longs, whatever the number of keys."""
    low, high = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("key", 32)
    at = keys.select(F.explode(F.array(*[F.pmod(low + high * i, F.lit(bits)) for i in range(HASHES)])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).collect()
    out = np.zeros((bits + 63) // 64, np.int64)
    for word, value in words:
        out[word] = value
    return out.view(np.uint64)


def filter_bits(keys: int, least: int = 1 << 20, most: int = 1 << 24) -> int:
    """Bits of a filter of that many keys: 16 each, within bounds; beyond them it lets more through."""
    return min(max(1 << (16 * keys).bit_length(), least), most)


def in_bloom(filter_: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    u = keys.view(np.uint64)
    low, high = u & np.uint64(0xFFFFFFFF), u >> np.uint64(32)
    out = np.ones(len(keys), bool)
    for i in range(HASHES):
        at = (low + high * np.uint64(i)) % np.uint64(bits)
        out &= (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def passes(filter_: np.ndarray, bits: int, key: Column) -> Column:
    """Whether the filter may hold the keys (long, not null); only they go to Python, not the rows."""

    @F.arrow_udf("boolean")
    def ask(keys: pa.Array) -> pa.Array:
        return pa.array(in_bloom(filter_, bits, keys.to_numpy()))

    return ask(key)


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, rules: tuple[Rule, ...] = RULES, to: str = "spans", filter_bits: int = 1 << 22) -> DataFrame:
    """The carried columns (all, if None) and spans: array of (kind, start, end), by start and then by the rules' order.

    Offsets are code points, end exclusive. A rule's matches are its leftmost non-overlapping ones; those
    whose group is shorter than its least length are dropped. Null and empty texts have no spans. Rows are
    treated one by one, so repeated rows each keep their own result; other columns only pass through.
    filter_bits bounds the filter; too small a filter means more texts to verify, never other results.
    """
    carry = docs.columns if carry is None else carry
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [q for q in queries if q is not ANY]
    bits, filter_ = filter_bits, None
    key = F.xxhash64(F.col(text))
    if indexed:
        grams = sorted({g for q in indexed for c in q for g in c})
        index = stored(postings(docs.select(key.alias("key"), F.col(text).alias("text")), grams), "postings")
        filter_ = bloom(candidates(index, indexed), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(i, r, q is ANY, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)).finditer) for i, (r, q) in enumerate(zip(rules, queries, strict=True))]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in pieces(batches):
            maybe = in_bloom(filter_, bits, b.column(0).to_numpy()) if filter_ is not None else np.zeros(b.num_rows, bool)
            out = []
            for t, cand in zip(b.column(1).to_pylist(), maybe.tolist(), strict=True):
                got = []
                if t:
                    for i, r, full, find in finders:
                        if full or cand:
                            got += [(m.start(), i, m.end()) for m in find(t) if m.end(r.group) - m.start(r.group) >= r.least]
                    got.sort()
                out.append([{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in got])
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, kind)], [*[f"c{i}" for i in range(b.num_columns - 2)], to])
        give_back()

    src = docs.select(key.alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*src.schema.fields[2:], StructField(to, ArrayType(span))])
    return src.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], to)


def has_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def span_list(spans: str, kinds: list[str] | None = None) -> Column:
    """The spans (of some kinds) as kind:start:end, joined by commas."""
    s = F.col(spans) if kinds is None else F.filter(spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: str, spans: str) -> Column:
    """The text with each span (overlapping ones together) replaced by its first kind in angle brackets."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        before = F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.when(fresh, F.concat(acc["out"], before, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, state, step)
    rest = F.substring(F.col(text), (done["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(done["out"], rest)).otherwise(F.col(text))
