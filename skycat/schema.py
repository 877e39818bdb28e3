"""Column resolution, missing values and schema contracts of catalogue tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that a catalogue may use for a canonical column, in order of preference.
POINT_ALIASES = {
    "longitude": ("l", "glon", "galactic_longitude", "lon", "longitude", "ra", "ra_deg", "raj2000"),
    "latitude": ("b", "glat", "galactic_latitude", "lat", "latitude", "dec", "dec_deg", "dej2000"),
}


def find_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of `names` that `df` has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    have = {c.lower() for c in df.columns}
    return sorted(n for n in required if n.lower() not in have)


def require(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """`df`, or a KeyError that lists the columns it lacks."""
    if gone := missing_columns(df, required):
        raise KeyError(f"missing columns: {', '.join(gone)}")
    return df


def contract_report(df: DataFrame, contract: Mapping[str, tuple[str, float | None, float | None]]) -> DataFrame:
    """(column, present, rows, missing, unreadable, outside): how `df` keeps a contract of column: (type, low, high).

    missing: null or NaN; unreadable: a value that the type can't hold; outside: readable, but below low or above high
    (None: no limit). One pass with partial counts over the columns that are there; an absent column has nulls for its
    counts, and no rows give counts of 0. Names are matched whatever their case.
    """
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    rows = []
    for name, (kind, low, high) in contract.items():
        if (found := find_column(df, [name])) is None:
            counts = [F.lit(None).cast("long")] * 3
        else:
            value = F.col(f"`{found}`")
            if dict(df.dtypes)[found] in ("float", "double"):
                value = F.nanvl(value, F.lit(None))
            read = value.try_cast(kind)
            beyond = [read < F.lit(low)] * (low is not None) + [read > F.lit(high)] * (high is not None)
            outside = F.lit(False)
            for b in beyond:
                outside = outside | b
            counts = [count(value.isNull()), count(value.isNotNull() & read.isNull()), count(F.coalesce(outside, F.lit(False)))]
        rows.append(F.struct(F.lit(name).alias("column"), F.lit(found is not None).alias("present"), F.count("*").alias("rows"), *(c.alias(n) for c, n in zip(counts, ("missing", "unreadable", "outside")))))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def resolve_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]], optional: Mapping[str, object] | None = None) -> DataFrame:
    """`df` projected to canonical names: the first alias found of each; `optional` gives constants for absent ones."""
    optional, columns, gone = dict(optional or {}), [], []
    for name, aliases in wanted.items():
        found = find_column(df, aliases)
        if found is not None:
            columns.append(F.col(f"`{found}`").alias(name))
        elif name in optional:
            columns.append(F.lit(optional[name]).alias(name))
        else:
            gone.append(name)
    if gone:
        raise KeyError(f"missing columns: {', '.join(sorted(gone))}")
    return df.select(*columns)


def finite(c: Column) -> Column:
    """The value as a double; NaN and infinities become null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clean(df: DataFrame) -> DataFrame:
    """All float columns with NaN and infinities as null, so that one kind of missing value is left."""
    floats = (T.FloatType, T.DoubleType)
    return df.select(*(finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name) for f in df.schema))


def with_unit(c: Column, name: str, unit: str) -> Column:
    """The column under a name, its unit in the column's metadata."""
    return c.alias(name, metadata={"unit": unit})


def strict_union(frames: Sequence[DataFrame]) -> DataFrame:
    """The union of chunks of one schema; a ValueError if names or types differ."""
    first, *rest = frames
    shape = [(f.name, f.dataType) for f in first.schema]
    for other in rest:
        if [(f.name, f.dataType) for f in other.schema] != shape:
            raise ValueError("chunks differ in schema")
        first = first.unionByName(other)
    return first
