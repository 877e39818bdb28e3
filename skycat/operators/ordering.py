"""Order over whole tables without gathering a table, or a group of it, in one task: chunks of sorted rows, what runs on
from chunk to chunk, places, first rows and exact percentiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written


def range_group(key: Column, points: Sequence[float]) -> Column:
    """How many of the ascending `points` are below or at `key`, found in two steps of about the root of their number."""
    if not points:
        return F.lit(0)
    step = math.isqrt(len(points) - 1) + 1
    below = lambda some: F.size(F.filter(some, lambda p: p <= key))
    first = F.greatest(below(F.array(*map(F.lit, points[::step]))) - 1, F.lit(0)) * step
    return F.coalesce(first + below(F.slice(F.array(*map(F.lit, points)), first + 1, F.lit(step))), F.lit(0)).cast("int")


def chunked(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows` in sorted chunks, written: __chunk ascends with (by, order), __at numbers the rows within and across them.

    Chunks are Spark's ranges of all these columns and, as the last of them, of the rows' places in the input. So equal
    keys, nulls and a group of any size are dealt to as many chunks as their share of the rows asks for. Nulls come
    first, equal rows in an order of their own that later steps keep, since they read it from the files.
    """
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn("__salt", F.monotonically_increasing_id())
    keys = [*by, *order, "__salt"]
    placed = keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("__salt").withColumn("__at", F.monotonically_increasing_id())
    return written(placed.withColumn("__chunk", F.shiftright("__at", 33).cast("int")), "chunks")


@dataclass(frozen=True)
class Step:
    """A column that runs on over the sorted rows of a group.

    kind: sum (up to the row itself), total and least (of the group), lag (the value of the row before), last and next (the
    nearest known value up to, or from, the row), or changes (rows up to this one that `differs` from the row before).
    """

    kind: str
    value: Column
    differs: Callable[[Column, Column], Column] | None = None


def scan(chunks: DataFrame, by: Sequence[str], **steps: Step) -> DataFrame:
    """`chunks` with a column for each step.

    A window runs inside each chunk of a group alone; one row for each of them goes through a window over the chunks and
    hands on what stands before and after it. Groups are matched with null keys too.
    """
    keys = ["__chunk", *by]
    inside = Window.partitionBy(*keys).orderBy("__at")
    before, after = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    local, sums = chunks, []
    for name, s in steps.items():
        local = local.withColumn(f"__v_{name}", s.value)
    for name, s in steps.items():
        v = F.col(f"__v_{name}")
        boxed = F.struct(v.alias("v"))
        if s.kind == "sum":
            local, sums = local.withColumn(name, F.sum(v).over(before)), [*sums, F.sum(v).alias(f"__s_{name}")]
        elif s.kind in ("total", "least"):
            sums.append((F.sum(v) if s.kind == "total" else F.min(v)).alias(f"__s_{name}"))
        elif s.kind == "lag":
            # the value is boxed, so that a null of the row before isn't taken for no row
            local, sums = local.withColumn(name, F.lag(boxed).over(inside)), [*sums, F.max_by(boxed, "__at").alias(f"__s_{name}")]
        elif s.kind == "last":
            local, sums = local.withColumn(name, F.last(v, True).over(before)), [*sums, F.max_by(v, F.when(v.isNotNull(), F.col("__at"))).alias(f"__s_{name}")]
        elif s.kind == "next":
            local, sums = local.withColumn(name, F.first(v, True).over(after)), [*sums, F.min_by(v, F.when(v.isNotNull(), F.col("__at"))).alias(f"__s_{name}")]
        elif s.kind == "changes":
            new = F.coalesce(s.differs(F.lag(v).over(inside), v).cast("int"), F.lit(0))
            local = local.withColumn(f"__c_{name}", new).withColumn(name, F.sum(f"__c_{name}").over(before))
            sums += [F.sum(f"__c_{name}").alias(f"__s_{name}"), F.min_by(boxed, "__at").alias(f"__f_{name}"), F.max_by(boxed, "__at").alias(f"__l_{name}")]
        else:
            raise ValueError(f"unknown kind of step: {s.kind}")
    carry = local.groupBy(*keys).agg(*sums)
    over = Window.partitionBy(*by).orderBy("__chunk")
    earlier, later = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    for name, s in steps.items():
        c = F.col(f"__s_{name}")
        if s.kind == "sum":
            given = F.sum(c).over(earlier)
        elif s.kind in ("total", "least"):
            given = (F.sum(c) if s.kind == "total" else F.min(c)).over(Window.partitionBy(*by))
        elif s.kind == "lag":
            given = F.lag(c).over(over)
        elif s.kind == "last":
            given = F.last(c, True).over(earlier)
        elif s.kind == "next":
            given = F.first(c, True).over(later)
        else:
            crossed = F.coalesce(s.differs(F.lag(f"__l_{name}").over(over)["v"], F.col(f"__f_{name}")["v"]).cast("int"), F.lit(0))
            carry = carry.withColumn(f"__x_{name}", crossed)
            given = F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.sum(f"__x_{name}").over(over.rowsBetween(Window.unboundedPreceding, 0))
        carry = carry.withColumn(f"__g_{name}", given)
    carry = carry.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(f"__g_{name}" for name in steps))
    same = local["__chunk"] == carry["__k___chunk"]
    for k in by:
        same = same & local[k].eqNullSafe(carry[f"__k_{k}"])
    out = local.join(carry, same)
    for name, s in steps.items():
        given = F.col(f"__g_{name}")
        if s.kind in ("sum", "changes"):
            out = out.withColumn(name, F.when(given.isNull(), F.col(name)).when(F.col(name).isNull(), given).otherwise(F.col(name) + given))
        elif s.kind in ("total", "least"):
            out = out.withColumn(name, given)
        elif s.kind == "lag":
            out = out.withColumn(name, F.coalesce(F.col(name), given)["v"])
        else:
            out = out.withColumn(name, F.coalesce(F.col(name), given))
    return out.select(*chunks.columns, *steps)


def with_row_number(rows: DataFrame, name: str, order: Sequence[str], first: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """`rows` with their place in the order of the columns, counted in each group of `by`; nulls come first.

    A chunk's numbers begin after the sizes of its group's chunks before it. Rows equal in all of `order` get places in
    an order of their own.
    """
    chunks = chunked(rows, by, order)
    sizes = chunks.groupBy("__chunk", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    starts = starts.select(F.col("__chunk").alias("__k"), *(F.col(k).alias(f"__k_{k}") for k in by), "__start")
    same = chunks["__chunk"] == starts["__k"]
    for k in by:
        same = same & chunks[k].eqNullSafe(starts[f"__k_{k}"])
    return chunks.join(starts if by else F.broadcast(starts), same).select(*rows.columns, (F.col("__start") + F.col("__at") + first).alias(name))


def first_rows(rows: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = (), intervals: int = 1024) -> DataFrame:
    """The first `n` rows (of each group of `by`, which are few) in an order whose first column is a number.

    Every group's span of that column is cut into intervals, which are counted. Intervals that lie whole among the first
    n rows are taken by a filter; only the rows of the one in which the n-th row falls are sorted, by chunks, however
    many they are. So no task keeps n rows. `rows` is read four times: write it first if it is costly to make.
    """
    lead = F.col(order[0]).cast("double")
    known = F.when(lead.isNotNull() & ~F.isnan(lead), lead)
    ends = rows.groupBy(*by).agg(F.min(known).alias("__low"), F.max(known).alias("__high")).toDF(*(f"__g_{k}" for k in by), "__low", "__high")

    def match(left: DataFrame, right: DataFrame) -> DataFrame:
        if not by:
            return left.crossJoin(F.broadcast(right))
        same = None
        for k in by:
            equal = left[k].eqNullSafe(right[f"__g_{k}"])
            same = equal if same is None else same & equal
        return left.join(F.broadcast(right), same)

    share = F.try_divide(lead - F.col("__low"), F.col("__high") - F.col("__low"))
    place = F.when(lead.isNull(), -1).when(F.isnan(lead), intervals).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * intervals), F.lit(intervals - 1))).cast("int")
    marked = match(rows, ends).withColumn("__i", place).drop("__low", "__high", *(f"__g_{k}" for k in by))
    sizes = marked.groupBy(*by, "__i").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = sizes.withColumn("__before", before).filter((F.col("__before") < n) & (F.col("__before") + F.col("__n") > n))
    split = written(split.select(*(F.col(k).alias(f"__g_{k}") for k in by), F.col("__i").alias("__at_i"), (F.lit(n) - F.col("__before")).alias("__left")), "split")
    full = sizes.withColumn("__before", before).filter(F.col("__before") + F.col("__n") <= n).groupBy(*by).agg(F.max("__i").alias("__last")).toDF(*(f"__g_{k}" for k in by), "__last")
    taken = match(marked, full).filter(F.col("__i") <= F.col("__last")).select(*rows.columns)
    if split.isEmpty():
        return taken
    rest = match(marked, split).filter(F.col("__i") == F.col("__at_i")).select(*rows.columns, "__left")
    rest = with_row_number(rest, "__place", order, 1, by).filter(F.col("__place") <= F.col("__left"))
    return taken.unionByName(rest.select(*rows.columns))


def group_percentiles(rows: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """(keys, p): the exact percentiles (linear between neighbours) of a column's known values in each group, an array.

    Equal values are counted together before anything moves, the counts run on over sorted chunks, and a percentile is
    the least value at which they pass its rank: neither ties nor a crowded group meet in one task. Groups are matched
    with null keys too. Groups without a known value have no row.
    """
    known = rows.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"))
    counted = known.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    run = scan(chunked(counted, keys, ["v"]), keys, up=Step("sum", F.col("n")), all=Step("total", F.col("n")))
    least = lambda place: F.min(F.when(F.col("up") > place, F.col("v")))
    ranks = [F.col("all").cast("double") * s - s for s in shares]
    found = run.groupBy(*keys).agg(F.max("all").alias("all"), *(least(F.floor(r)).alias(f"a{i}") for i, r in enumerate(ranks)), *(least(F.floor(r) + 1).alias(f"b{i}") for i, r in enumerate(ranks)))
    out = []
    for i, r in enumerate(ranks):
        a, b, part = F.col(f"a{i}"), F.col(f"b{i}"), r - F.floor(r)
        out.append(F.when(part == 0, a).otherwise(a + (F.coalesce(b, a) - a) * part))
    return found.select(*keys, F.array(*out).alias("p"))


def percentiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """group_percentiles of a whole column, on the driver; nulls if nothing is known."""
    found = group_percentiles(rows, [], column, shares).first()
    return [None for _ in shares] if found is None or found.p[0] is None else list(found.p)
