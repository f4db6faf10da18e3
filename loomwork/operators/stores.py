"""Table, key-value and set verbs as rewrites of immutable tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import format_cell
from loomwork.operators.lookup import predicate

# tables -----------------------------------------------------------------------------------------


def _only_if_none(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """`df`, or an error when it is evaluated if `bad` has rows."""
    okay = bad.agg(F.coalesce(F.when(F.count("*") > 0, F.raise_error(F.lit(message)).cast("boolean")), F.lit(True)).alias("okay_"))
    return df.join(F.broadcast(okay)).where("okay_").drop("okay_")  # one row


def insert(df: DataFrame, rows: DataFrame, key: str | None = None) -> DataFrame:
    """Append rows; a key that is there already, or twice among the rows, raises when the result is evaluated."""
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in df.schema])
    if key is None:
        return df.unionByName(rows)
    clash = rows.select(key).unionByName(df.join(rows.select(key), key, "left_semi").select(key)).groupBy(key).count().where("count > 1")
    return df.unionByName(_only_if_none(rows, clash, "duplicate key"))


def insert_if_absent(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append the rows whose key is not there; of several new rows with one key any one."""
    new = rows.dropDuplicates([key]).join(df.select(key), key, "left_anti")
    return df.unionByName(new.select(*df.columns))


def upsert(df: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Replace or add rows by key; of several new rows with one key the last by `order`."""
    if order is not None:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns]), order).alias("r_")).select("r_.*")
    return df.join(rows.select(key), key, "left_anti").select(*df.columns).unionByName(rows.select(*df.columns))


def update(df: DataFrame, column: str, value, changes: dict) -> DataFrame:
    """SET changes WHERE column = value."""
    if not changes:
        raise ValueError("no changes")
    unknown = set(changes) - set(df.columns)
    if unknown:
        raise KeyError(sorted(unknown)[0])
    hit = F.coalesce(predicate(df, **{column: value}), F.lit(False))
    return df.select(*[F.when(hit, F.lit(changes[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in df.schema])


def delete(df: DataFrame, column: str, value) -> DataFrame:
    """DELETE WHERE column = value; rows with a null stay."""
    return df.filter(~F.coalesce(predicate(df, **{column: value}), F.lit(False)))


def affected(df: DataFrame, column: str, value) -> DataFrame:
    """One row: how many rows an update or delete meets."""
    return df.filter(predicate(df, **{column: value})).agg(F.count("*").alias("n"))


def cleared(df: DataFrame) -> DataFrame:
    return df.limit(0)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


# key-value ----------------------------------------------------------------------------------------


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by `order`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r_")).select(key, "r_.*")


def ordered_items(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(key, value).orderBy(key)


def as_map(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row with a map; for tables that fit one row."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("map"))


def as_json_object(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return as_map(df, key, value).select(F.to_json("map").alias("json"))


def as_json_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """One row with a JSON array of records in order; for small tables."""
    sort = F.struct(*order, F.struct(*df.columns).alias("r_"))
    return df.agg(F.array_sort(F.collect_list(sort)).alias("rows_")).select(F.to_json(F.transform("rows_", lambda r: r["r_"])).alias("json"))


def as_json_list(values: DataFrame, column: str = "value") -> DataFrame:
    """One row with a JSON array of a set's values in order; for sets that fit one row."""
    return values.agg(F.to_json(F.array_sort(F.collect_set(column))).alias("json"))


# sets (one column of distinct values) -----------------------------------------------------------------


def as_set(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.select(F.col(column).alias(name)).distinct()


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One pass: the values that only one side has."""
    both = a.distinct().withColumn("side_", F.lit(1)).unionByName(b.distinct().withColumn("side_", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.count("*").alias("n_")).where("n_ = 1").drop("n_")


def _none(df: DataFrame, name: str) -> DataFrame:
    return df.limit(1).agg((F.count("*") == 0).alias(name))


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    return _none(a.join(b, a.columns, "left_anti"), "subset")


def is_superset(a: DataFrame, b: DataFrame) -> DataFrame:
    return _none(b.join(a, a.columns, "left_anti"), "superset")


def is_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    return _none(a.join(b, a.columns, "left_semi"), "disjoint")


def all_equal(*sets: DataFrame) -> DataFrame:
    """One row: whether all sets hold the same values."""
    marked = reduce(DataFrame.unionByName, [s.distinct().withColumn("side_", F.lit(k)) for k, s in enumerate(sets)])
    return _none(marked.groupBy(*sets[0].columns).agg(F.count("*").alias("n_")).where(F.col("n_") < len(sets)), "equal")


def discard(df: DataFrame, values: DataFrame) -> DataFrame:
    return df.join(values, df.columns, "left_anti")


def remove(df: DataFrame, values: DataFrame) -> DataFrame:
    """Like discard, but a value that isn't there raises when the result is evaluated."""
    return _only_if_none(discard(df, values), values.join(df, df.columns, "left_anti"), "no such value")


# text sinks -------------------------------------------------------------------------------------------


def boolean_text(c: str | Column) -> Column:
    return F.initcap(F.col(c).cast("string")) if isinstance(c, str) else F.initcap(c.cast("string"))


def to_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; booleans as True and False."""
    cols = [boolean_text(f.name).alias(f.name) if f.dataType.typeName() == "boolean" else F.col(f.name) for f in df.schema]
    df.select(*cols).write.csv(path, header=True)


def aligned(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Every column as text padded to the widest value; doubles with fixed digits, nulls empty."""
    text = [F.coalesce(F.when(F.col(f.name).isNotNull(), F.format_string(f"%.{digits}f", F.col(f.name))) if digits is not None and f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema]
    t = df.select(*text)
    widths = t.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"w_{c}") for c in df.columns])
    return t.join(F.broadcast(widths)).select(*[F.rpad(c, F.col(f"w_{c}"), F.lit(" ")).alias(c) for c in df.columns])  # one row


def cell_text(column: str, kind: str, digits: int = 5) -> Column:
    """A value as a table's text: - for null, X for true, numbers as `format_cell` writes them, all else as it is."""
    c = F.col(column)
    text = format_cell(c, digits) if kind in ("double", "float") else F.when(c, "X") if kind == "boolean" else c.cast("string")
    return F.coalesce(text, F.lit("-"))


def table_cells(df: DataFrame, table: Column, place: Column, order: list[str], columns: list[str], digits: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, table, place (of the table in its set), row (a struct to sort by), i, head, text, number, known of a DataFrame that holds one or more tables."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    numeric = ("double", "float", "integer", "long", "short", "byte", "decimal", "boolean")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("head"), cell_text(c, kinds[c], digits).alias("text"), F.lit(kinds[c] in numeric).alias("number"), F.col(c).isNotNull().alias("known")) for i, c in enumerate(columns)])
    return df.select(*keys, table.alias("table"), place.alias("place"), F.struct(*order).alias("row"), F.inline(cells))


def text_of_tables(cells: DataFrame, indent: str = "  ", gap: int = 2, rule: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, table, place, text: each table of `table_cells` as aligned text: its name, header, rule, then its rows in order.

    A column is as wide as its widest cell or its head; numbers (and columns without any value) stand
    right. Widths are grouped maxima, lines are made one by one, and only finished lines meet in their
    table's text.
    """
    own = [*keys, "table", "place"]
    line = lambda cell: F.concat(F.lit(indent), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cell.alias("c")))), lambda x: x["c"]), " " * gap))
    same = lambda lead: [F.col(k).eqNullSafe(F.col(f"{lead}_{k}")) for k in own]
    widths = cells.groupBy(*own, "i", "head").agg(F.greatest(F.max(F.length("text")), F.length("head")).alias("wide"), (F.max("number") | ~F.max("known")).alias("right"))
    w = widths.select(*[F.col(k).alias(f"w_{k}") for k in own], F.col("i").alias("w_i"), "wide", "right")
    c = cells.join(w, [*same("w"), F.col("i") == F.col("w_i")])
    padded = F.when(F.col("right"), F.lpad("text", F.col("wide"), F.lit(" "))).otherwise(F.rpad("text", F.col("wide"), F.lit(" ")))
    lines = c.groupBy(*own, "row").agg(line(padded).alias("line"))
    body = lines.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    heads = widths.groupBy(*[F.col(k).alias(f"h_{k}") for k in own]).agg(line(F.rpad("head", F.col("wide"), F.lit(" "))).alias("head"))
    below = F.concat(F.lit("\n" + indent), F.repeat(F.lit("-"), F.length("head") - len(indent) + 10)) if rule else F.lit("")
    return body.join(heads, same("h")).select(*own, F.concat("table", F.lit("\n"), "head", below, F.lit("\n"), "body", F.lit("\n")).alias("text"))


def joined_tables(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the table texts of each set in the order of `place`, an empty line between them."""
    parts = F.array_sort(F.collect_list(F.struct("place", "table", "text")))
    return texts.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
