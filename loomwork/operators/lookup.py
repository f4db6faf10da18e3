"""Keyword lookups on tables: find(df, score__gt=90, active=True) as one pushed-down predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPERATORS = {
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "ne": lambda c, v: c != v,
}


def predicate(df: DataFrame, **lookups) -> Column | None:
    """The lookups joined by AND; None without any. Unknown columns and suffixes raise here, before a job.

    The suffix stands after the last double underscore. A value None finds nothing, and __ne leaves
    out rows where the column is null, as comparisons with null do.
    """
    terms = []
    for key, value in lookups.items():
        name, _, suffix = key.rpartition("__")
        if not name:
            name, suffix = key, ""
        if suffix and suffix not in _OPERATORS:
            raise ValueError(f"unknown lookup suffix: {suffix}")
        if name not in df.columns:
            raise KeyError(name)
        own = F.lit(value) if value is None else F.lit(value).cast(df.schema[name].dataType)
        terms.append(_OPERATORS[suffix](F.col(name), own) if suffix else F.col(name) == own)
    return reduce(lambda a, b: a & b, terms) if terms else None


def find(df: DataFrame, **lookups) -> DataFrame:
    """The rows that all lookups hold for; all rows without lookups."""
    p = predicate(df, **lookups)
    return df if p is None else df.filter(p)


def get(df: DataFrame, column: str, value) -> DataFrame:
    return find(df, **{column: value})


def get_column(df: DataFrame, column: str, **lookups) -> DataFrame:
    """One column, duplicates kept."""
    if column not in df.columns:
        raise KeyError(column)
    return find(df, **lookups).select(column)


def get_or(df: DataFrame, key: str, value, wanted: str, default) -> DataFrame:
    """One row: the column `wanted` where key = value, or the default."""
    return get(df, key, value).agg(F.coalesce(F.min(wanted), F.lit(default)).alias(wanted))


def contains(df: DataFrame, **lookups) -> DataFrame:
    """One row: whether any row is found."""
    return find(df, **lookups).limit(1).agg((F.count("*") > 0).alias("found"))


def is_truthy(c: str | Column) -> Column:
    """Text to boolean: only `true` (in any case) and `1` are true; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c)).isin("true", "1")


_TYPES = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}


def table_schema(columns: dict[str, type], primary_key: str | None = None) -> T.StructType:
    """A schema of the four scalar types; the key must be one of the columns."""
    if not columns:
        raise ValueError("a table needs a column")
    if primary_key is not None and primary_key not in columns:
        raise ValueError(f"no such column: {primary_key}")
    bad = [n for n, t in columns.items() if t not in _TYPES]
    if bad:
        raise TypeError(f"only str, int, float and bool are columns: {bad}")
    return T.StructType([T.StructField(n, _TYPES[t], n != primary_key) for n, t in columns.items()])


def match_schema(df: DataFrame, columns: dict[str, type]) -> DataFrame:
    """The columns in the declared order and types; another set of columns raises. Int fits float, bool fits int."""
    if set(df.columns) != set(columns):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(columns))}")
    return df.select(*[F.col(n).cast(_TYPES[t]).alias(n) for n, t in columns.items()])


def select_names(df: DataFrame, name: str, selectors: list[str]) -> DataFrame:
    """Rows of sorted distinct names by selectors: an index (negative from the end), a slice a:b, or a name.

    Order of the selectors is kept and a name comes once. An index out of range or an unknown name raises
    here: a small job looks for each.
    """
    from loomwork.operators.rank import numbered

    ranked = numbered(df.select(name).distinct(), [name], "rn").withColumn("n", F.lit(df.select(name).distinct().count()))
    parts = []
    for at, s in enumerate(selectors):
        a, colon, b = s.partition(":")
        if colon:
            lo = int(a) if a else 0
            hi = int(b) if b else None
            low = F.greatest(F.lit(0), F.lit(lo) + (F.col("n") if lo < 0 else 0))
            high = F.col("n") if hi is None else F.least(F.col("n"), F.lit(hi) + (F.col("n") if hi < 0 else 0))
            rows = ranked.where((F.col("rn") > low) & (F.col("rn") <= high))
        elif s.lstrip("-").isdigit():
            rows = ranked.where(F.col("rn") == F.lit(int(s) + 1) + (F.col("n") if int(s) < 0 else 0))
        else:
            rows = ranked.where(F.col(name) == s)
        if not colon and rows.isEmpty():
            raise KeyError(s)
        parts.append(rows.select(name, "rn", F.lit(at).alias("at")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(name).agg(F.min(F.struct("at", "rn")).alias("o")).orderBy("o").select(name)


def nested(df: DataFrame, structs: dict[str, dict[str, str]]) -> DataFrame:
    """Flat columns as structs: the name of each struct and, by field, the column that it takes; the other columns stay."""
    used = {c for fields in structs.values() for c in fields.values()}
    own = [F.struct(*[F.col(c).alias(f) for f, c in fields.items()]).alias(name) for name, fields in structs.items()]
    return df.select(*[c for c in df.columns if c not in used], *own)


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Structs, at any depth, as columns named after their path; two columns of one name raise."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in kind:
            out += leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)]
        return out

    paths = leaves(df.schema, ())
    names = [separator.join(p) for p in paths]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of one name: {sorted({n for n in names if names.count(n) > 1})}")
    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(n) for p, n in zip(paths, names, strict=True)])
