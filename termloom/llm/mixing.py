"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Token rates minimise their relative entropy to the corpus under token constraints: the tokens taken of each
value of a margin column (a source, say) meet a target. The dual is convex and its solution tilts documents
exponentially: rate = exp(sum of the multipliers of the document's margin values). Newton steps on the dual
run as aggregates over cells, the distinct combinations of margin values. Rates are then rounded into whole
copies: all documents get the floor, and those with the least hashes one more, up to a cut of each source
that leaves its tokens at the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
LEVEL_BITS = 12
LEVELS = 3
MOVES = 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sizes_of(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source, group (never null), size and h of every row; equal rows share h."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), *row_marks(key, text, source), word_count(text).alias("size"))


def row_marks(key: str, text: str, source: str) -> list[Column]:
    group = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))
    return [group.alias("group"), F.xxhash64(F.col(key), F.col(text), F.lit("mix")).alias("h")]


def numbered(groups: DataFrame) -> DataFrame:
    """Add no, the place of each source by code point with null last, without one task that holds them all."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(groups.repartitionByRange(n, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "ranged")
    per = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row per partition
    w = Window.partitionBy("part").orderBy(F.col("source").isNull(), F.col("source"))
    return ranged.join(before, "part").withColumn("no", F.coalesce("before", F.lit(0)) + F.row_number().over(w) - 1).drop("part", "before")


def targets(groups: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MOST_COPIES) -> DataFrame:
    """Add weight and target to groups (source, group, total): weights repeat by code point, null last.

    Targets share the sum of all totals by weight and stop at cap times their total; what is cut off is
    shared by weight among the others until none is above. Each round is one aggregate, and caps one more
    source at least.
    """
    x = numbered(groups).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("no", F.lit(len(weights))) + 1).cast("int")))
    x = stored(x.withColumns({"most": F.col("total") * float(cap), "capped": F.lit(False)}).drop("no"), "groups")
    whole = x.agg(F.sum("total")).first()[0] or 0
    level = None
    while True:
        over = (F.col("weight") * level > F.col("most")) if level is not None else F.lit(False)
        held, free, n = x.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        now = (whole - (held or 0)) / free if free else None
        if now is None or now == level:
            break
        if level is not None and now < level:  # rounding
            break
        level = now
        del n
    if level is None:
        return x.withColumn("target", F.col("most")).drop("most", "capped")
    return x.withColumn("target", F.least(F.col("weight") * level, F.col("most"))).drop("most", "capped")


def balance(cells: DataFrame, margins: list[tuple[str, str]], base: str = "total", tolerance: float = 1e-10, most_rounds: int = 100) -> DataFrame:
    """Solve the dual by Newton steps. cells has the margin columns, base tokens and per margin a target column.

    margins: (value column, target column), each target stated for the whole margin value. Adds rate. The
    Hessian of one margin is diagonal, so each block step is one aggregate per margin value and a join;
    one margin converges quadratically, several alternate. Values without tokens or with target 0 keep
    their multiplier's limit: rate 1 without tokens, 0 with a target of 0.
    """
    x = stored(cells.withColumn("lam", F.lit(0.0)), "cells")
    for _ in range(most_rounds):
        for value, target in margins:
            mass = x.groupBy(value).agg(F.sum(F.col(base) * F.exp("lam")).alias("_mass"), F.max(target).alias("_aim"))
            step = F.when((F.col("_mass") > 0) & (F.col("_aim") > 0), F.col("_aim") / F.col("_mass") - 1).otherwise(F.when(F.col("_mass") > 0, F.lit(float("-inf"))).otherwise(0.0))
            x = stored(x.join(mass.select(value, F.least(step, F.lit(2.0)).alias("_step")), value).withColumn("lam", F.col("lam") + F.col("_step")), "newton").drop("_step")
        worst = 0.0
        for value, target in margins:
            mass = x.groupBy(value).agg(F.sum(F.col(base) * F.exp("lam")).alias("_mass"), F.max(target).alias("_aim"))
            worst = max(worst, mass.agg(F.max(F.when(F.col("_aim") > 0, F.abs(F.col("_mass") / F.col("_aim") - 1)).otherwise(F.lit(0.0)))).first()[0] or 0.0)
        if worst < tolerance:
            return x.withColumn("rate", F.exp("lam")).drop("lam")
    raise RuntimeError(f"entropy balancing did not settle: {worst}")


def _prefix(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - LEVEL_BITS * level)


def plan(sizes: DataFrame, groups: DataFrame, cap: int = MOST_COPIES) -> DataFrame:
    """Per group: floor (copies of every row), cut (rows with a hash prefix below get one more), more and less (hashes that get one more or less).

    sizes: group, size, h; groups: group, total, target, rate. The cut is found level by level from sums
    per hash bucket (2 ** 12 a level, 36 bits in all), so no task orders the rows of a source. Then, MOVES
    times, the row whose copy more or less brings the rest nearest to 0 is changed.
    """
    low = F.least(F.floor(F.col("rate") + 1e-9).cast("long"), F.lit(cap).cast("long"))
    x = groups.withColumn("floor", low).withColumn("need", F.when(F.col("floor") >= cap, F.lit(0).cast("long")).otherwise(F.greatest(F.round(F.col("target")).cast("long") - F.col("floor") * F.col("total"), F.lit(0).cast("long"))))
    x = stored(x.withColumns({"at": F.lit(0).cast("long"), "left": F.col("need")}), "plan")
    for level in range(1, LEVELS + 1):
        inside = sizes.join(x.select("group", "at", "left"), "group").where((F.col("left") > 0) & (_prefix(level - 1) == F.col("at"))) if level > 1 else sizes.join(x.where("left > 0").select("group", "at", "left"), "group")
        sums = inside.groupBy("group", _prefix(level).alias("bucket")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        w = Window.partitionBy("group").orderBy("bucket")
        run = sums.withColumn("upto", F.sum("size").over(w))
        hit = run.where(F.col("upto") > F.col("left")).groupBy("group").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"))).alias("s"))
        first = F.shiftleft(F.col("at"), LEVEL_BITS)
        end = first + F.lit(1 << LEVEL_BITS)  # nothing goes over: all buckets of this prefix are taken
        x = stored(x.join(hit, "group", "left").withColumns({"at": F.coalesce("s.bucket", F.when(F.col("left") > 0, end).otherwise(first)), "left": F.when(F.col("s").isNull(), F.when(F.col("left") > 0, F.lit(0).cast("long")).otherwise(F.col("left"))).otherwise(F.col("left") - F.col("s.before"))}).drop("s"), "plan")
    x = x.withColumnRenamed("at", "cut").drop("left")
    taken = sizes.join(x.select("group", "cut"), "group").where(_prefix(LEVELS) < F.col("cut")).groupBy("group").agg(F.sum("size").alias("got"))
    none = F.array().cast("array<bigint>")
    x = stored(x.join(taken, "group", "left").withColumns({"rest": F.col("need") - F.coalesce("got", F.lit(0)), "more": none, "less": none}).drop("got", "need"), "plan")
    for _ in range(MOVES):
        y = sizes.join(x.select("group", "floor", "cut", "rest", "more", "less"), "group")
        y = y.where((F.col("rest") != 0) & (F.col("size") > 0) & ~F.array_contains("more", F.col("h")) & ~F.array_contains("less", F.col("h")))
        up = F.when(copies() < cap, F.abs(F.col("rest") - F.col("size")))
        down = F.when(copies() > 0, F.abs(F.col("rest") + F.col("size")))
        y = y.withColumns({"off": F.least(up, down), "up": F.coalesce(up <= F.coalesce(down, up), F.lit(False))}).where(F.col("off") < F.abs("rest"))
        best = y.groupBy("group").agg(F.min(F.struct("off", "h", "up", "size")).alias("b"))
        moved = x.join(best, "group", "left")
        one = F.array("b.h")
        x = stored(moved.withColumns({
            "more": F.when(F.col("b.up"), F.concat("more", one)).otherwise(F.col("more")),
            "less": F.when(~F.col("b.up"), F.concat("less", one)).otherwise(F.col("less")),
            "rest": F.col("rest") - F.coalesce(F.when(F.col("b.up"), F.col("b.size")).otherwise(-F.col("b.size")), F.lit(0))}).drop("b"), "plan")
    return x


def copies() -> Column:
    """Copies of a row with h, floor, cut, more and less."""
    below, more, less = (c.cast("long") for c in (_prefix(LEVELS) < F.col("cut"), F.array_contains("more", F.col("h")), F.array_contains("less", F.col("h"))))
    return F.col("floor") + below + more - less


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: int = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): the row table and the plan per source, from which copies() gives each row's copies.

    A null text has size 0, a null source is a source of its own. Rows that agree in every named column are
    interchangeable and get the same copies, so they go above or below the cut together. Sources without
    a word have target 0 and keep their rows once. Only the named columns are looked at; an empty table
    gives an empty mix. Reruns agree, as every choice is by hash.
    """
    sizes = stored(sizes_of(docs, key, text, source), "sizes")
    groups = sizes.groupBy("group").agg(F.first("source").alias("source"), F.sum("size").alias("total"))
    aimed = targets(stored(groups, "totals"), weights, cap)
    rated = balance(aimed, [("group", "target")])
    return sizes, plan(sizes, rated, cap)
