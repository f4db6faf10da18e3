"""Tables, key-value files, sets, listings and small text formats as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.columns import coerce_cell, file_stem, quoted_tokens
from loomwork.operators.lookup import is_truthy, match_schema, table_schema


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_csv(spark: SparkSession, path: str, columns: dict[str, type]) -> DataFrame:
    """CSV with a header; booleans are true for `true` and `1` only; numbers that don't parse raise."""
    text = T.StructType([T.StructField(n, T.StringType() if t is bool else f.dataType) for (n, t), f in zip(columns.items(), table_schema(columns), strict=True)])
    df = spark.read.schema(text).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    return df.select(*[F.coalesce(is_truthy(n), F.lit(False)).alias(n) if t is bool else F.col(n) for n, t in columns.items()])


def table_json(spark: SparkSession, path: str, columns: dict[str, type]) -> DataFrame:
    """A JSON array of records with exactly the declared columns."""
    return match_schema(spark.read.json(path, multiLine=True), columns)


def key_value_csv(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a two-column CSV. A file's first row `key,value` is a header; short rows are dropped; the last of a key stays.

    Rows stand in the order of file, place of the split, and row in the split, however Spark cuts the files.
    """
    df = spark.read.schema("key string, value string").csv(path, header=False, mode="PERMISSIVE")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    df = df.withColumn("at_", place)
    first = df.groupBy(F.col("at_.file").alias("f_")).agg(F.min("at_").alias("first_"))
    df = df.join(first, F.col("at_.file") == F.col("f_")).where("value IS NOT NULL AND NOT (at_ = first_ AND key = 'key' AND value = 'value')")
    return df.groupBy("key").agg(F.max_by("value", "at_").alias("value"))


def key_value_json(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a JSON object of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def set_json(spark: SparkSession, path: str) -> DataFrame:
    """value of a JSON array of strings, each once."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value")).distinct()


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def commented_list(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; # begins a comment."""
    return spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("value")).where("value <> ''")


def job_rows(lines: DataFrame, header: tuple[str, ...] = ("model", "weight", "dataset")) -> DataFrame:
    """Jobs of a comma-separated list: blank lines, comments, the header and rows of another length are skipped."""
    parts = lines.select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("p")).where(F.size("p") == len(header))
    parts = parts.where(~F.get("p", F.lit(0)).startswith("#") & (F.lower(F.get("p", F.lit(0))) != header[0]))
    return parts.select(*[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(header)])


def listing(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """path, name, stem, length, modified of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    d = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    d = d.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).withColumn("stem", file_stem("path"))
    return d if hidden else d.where(~F.col("name").startswith("."))


def with_extensions(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.where(F.regexp_extract("name", r"(\.[^.]*)$", 1).isin(extensions))


def with_keyword(files: DataFrame, keyword: str) -> DataFrame:
    """Names that hold the keyword, but not at their start."""
    return files.where(F.instr("name", keyword) > 1)


def unique_names(files: DataFrame, name: str = "stem") -> DataFrame:
    """Files by name; a name that comes twice raises when the result is evaluated."""
    g = files.groupBy(name).agg(F.min("path").alias("path"), F.count("*").alias("n"))
    bad = F.raise_error(F.concat(F.lit("name comes twice: "), F.col(name))).cast("boolean")
    return g.where(F.when(F.col("n") > 1, bad).otherwise(True)).drop("n")


def folder_stats(files: DataFrame) -> DataFrame:
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.count("*").alias("n_files"), F.count_distinct(folder).alias("n_folders"))


def decoded(content: Column | str, charsets: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> Column:
    """Bytes as text by the first charset that can be read; a byte order mark is dropped."""
    c = F.col(content) if isinstance(content, str) else content
    texts = [F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")) if s == "UTF-8" else F.decode(c, s) for s in charsets]
    return F.regexp_replace(F.coalesce(*texts), "^﻿", "")


def text_tables(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, table, row, column, cell, kind, number of texts with several named tables.

    A line without indent names a table, its first indented line is the header, lines of dashes are
    rules, # begins a comment line. Fields stand between tabs or two spaces; rows that are short are
    filled with nulls, cells beyond the header are dropped.
    """
    d = docs.select(doc, F.posexplode(F.split(text, r"\r?\n")).alias("line_", "t_"))
    d = d.where((F.trim("t_") != "") & ~F.trim("t_").startswith("#") & ~F.trim("t_").rlike(r"^[-=\s]+$"))
    w = Window.partitionBy(doc).orderBy("line_")
    d = d.withColumn("table", F.last(F.when(~F.col("t_").rlike(r"^\s"), F.trim("t_")), ignorenulls=True).over(w)).where(F.col("t_").rlike(r"^\s") & F.col("table").isNotNull())
    d = d.withColumn("row", F.row_number().over(Window.partitionBy(doc, "table").orderBy("line_")) - 1).withColumn("f_", F.split(F.trim("t_"), r"\t+|\s{2,}"))
    d = d.withColumn("head_", F.first(F.when(F.col("row") == 0, F.col("f_")), ignorenulls=True).over(Window.partitionBy(doc, "table").orderBy("row"))).where("row > 0")
    cells = d.select(doc, "table", "row", F.posexplode("head_").alias("i_", "column"), "f_")
    cells = cells.select(doc, "table", "row", "column", F.get("f_", F.col("i_")).alias("cell"))
    return cells.withColumn("c_", coerce_cell("cell")).select(doc, "table", "row", "column", "cell", F.coalesce("c_.kind", F.lit("null")).alias("kind"), F.col("c_.number").alias("number"))


def stanza_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line, parent, keyword, params of indented keyword texts: the parent is the last line before with a smaller indent.

    Lines are looked at within their document; the number of different indents is small, so the last
    line of each smaller indent is kept as a map in an ordered fold.
    """
    d = docs.select(doc, F.posexplode(F.split(text, r"\r?\n")).alias("line", "t_")).where((F.trim("t_") != "") & ~F.trim("t_").startswith("!"))
    indent = F.length(F.regexp_extract(F.regexp_replace("t_", "\t", "    "), "^( *)", 1))
    d = d.withColumn("indent_", indent).withColumn("tokens_", quoted_tokens(F.trim("t_")))
    g = d.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("line", "indent_", "tokens_"))).alias("l_"))
    start = F.expr("struct(cast(array() AS array<struct<line:int,indent_:int>>) AS open, cast(array() AS array<int>) AS parents)")

    def step(s: Column, x: Column) -> Column:
        left = F.filter(s["open"], lambda o: o["indent_"] < x["indent_"])
        own = F.struct(x["line"].alias("line"), x["indent_"].alias("indent_"))
        return F.struct(F.concat(left, F.array(own)).alias("open"), F.concat(s["parents"], F.array(F.try_element_at(left, F.lit(-1))["line"])).alias("parents"))

    g = g.withColumn("p_", F.aggregate("l_", start, step)["parents"])
    out = g.select(doc, F.explode(F.arrays_zip("l_", "p_")).alias("z"))
    return out.select(doc, F.col("z.l_.line").alias("line"), F.col("z.p_").alias("parent"), F.get("z.l_.tokens_", F.lit(0)).alias("keyword"), F.expr("slice(z.l_.tokens_, 2, size(z.l_.tokens_))").alias("params"))


def glass_rows(stanzas: DataFrame) -> DataFrame:
    """name, nd, vd of a glass catalogue's NM stanzas."""
    p = lambda k: F.get("params", F.lit(k))
    return stanzas.where("keyword = 'NM'").select(p(0).alias("name"), p(3).try_cast("double").alias("nd"), p(4).try_cast("double").alias("vd"))


def matrix_text(docs: DataFrame, doc: str, text: str, marker: str) -> DataFrame:
    """doc, row, values: the numbers after a marker line; rows of different lengths raise when evaluated."""
    d = docs.select(doc, F.posexplode(F.split(F.substring_index(text, marker, -1), r"\r?\n")).alias("row", "t_")).where(F.trim("t_") != "")
    d = d.select(doc, "row", F.transform(F.split(F.trim(F.regexp_replace("t_", "[Xx]", "")), r"\s+"), lambda v: v.cast("double")).alias("values"))
    w = Window.partitionBy(doc)
    same = F.min(F.size("values")).over(w) == F.max(F.size("values")).over(w)
    d = d.withColumn("same_", same)
    return d.where(F.when(~F.col("same_"), F.raise_error(F.lit("rows differ in length")).cast("boolean")).otherwise(True)).drop("same_")


def tensor_rows(df: DataFrame, key: str, array: str, shape: list[int], dtype: str = "float64") -> DataFrame:
    """key, shape, dtype, data: shapes can be read without the data, by column pruning."""
    return df.select(F.col(key).cast("string").alias("key"), F.array(*[F.lit(n) for n in shape]).alias("shape"), F.lit(dtype).alias("dtype"), F.col(array).alias("data"))


def keys_with_prefix(tensors: DataFrame, prefix: str) -> DataFrame:
    return tensors.select("key").where(F.col("key").startswith(prefix)).orderBy("key")


def renamed_pairs(pairs: DataFrame, order: list[str], digits: int) -> DataFrame:
    """Pairs with a shared name: their number from 0 with leading zeros."""
    from loomwork.operators.rank import numbered

    return numbered(pairs, order, "rn_").withColumn("shared_name", F.lpad((F.col("rn_") - 1).cast("string"), digits, "0")).drop("rn_")


def manifest_pairs(lines: DataFrame, line: str, low_root: str, high_root: str, template: str = "{}") -> DataFrame:
    """`lines` with low and high: the paths of each listed file and of its partner, whose stem follows the template.

    A line names the file first; what follows the first blank is a remark.
    """
    name = F.substring_index(F.trim(line), " ", 1)
    stem, end = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    before, _, after = template.partition("{}")
    low = F.concat(F.lit(low_root.rstrip("/") + "/"), F.lit(before), stem, F.lit(after), end)
    return lines.where(F.trim(line) != "").withColumns({"low": low, "high": F.concat(F.lit(high_root.rstrip("/") + "/"), name)})


def glass_catalogues(docs: DataFrame, catalog: str, text: str) -> DataFrame:
    """name, nd, vd and the catalogue of the glasses of several catalogue texts."""
    rows = stanza_lines(docs, catalog, text)
    p = lambda k: F.get("params", F.lit(k))
    return rows.where("keyword = 'NM'").select(p(0).alias("name"), p(3).try_cast("double").alias("nd"), p(4).try_cast("double").alias("vd"), F.col(catalog))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, mode and data of image files; files that are no image are left out."""
    d = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return d.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "mode", "data")
