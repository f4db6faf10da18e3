"""Lens prescriptions: stanza lines (files.stanza_lines) pivoted to the SURFACES and ASPHERIC tables.

One grouped aggregate per surface, one join to the glass catalogue. Lengths are in millimetres; other
units, unknown glasses and unknown surface types raise when the result is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aspheric terms A4 to A16.
TERMS = 7


def _raise(message: Column) -> Column:
    return F.raise_error(message).cast("boolean")


def _children(stanzas: DataFrame, doc: str) -> DataFrame:
    """Each child line of a SURF stanza with the number of its surface."""
    surf = stanzas.where("keyword = 'SURF'").select(F.col(doc).alias("s_doc"), F.col("line").alias("s_line"), F.get("params", F.lit(0)).try_cast("int").alias("surface"))
    # lines come from unfolded texts, whose number Spark doesn't foresee: no broadcast
    return stanzas.join(surf.hint("merge"), (F.col(doc) == F.col("s_doc")) & (F.col("parent") == F.col("s_line"))).drop("s_doc", "s_line")


def _first(keyword: str, k: int) -> Column:
    """Aggregate: parameter k of the first child line with the keyword."""
    return F.min(F.when(F.col("keyword") == keyword, F.struct("line", F.get("params", F.lit(k)).alias("v"))))["v"]


def surfaces(stanzas: DataFrame, doc: str, glasses: DataFrame) -> DataFrame:
    """doc, i, STOP, SHAPE, R, D, Nd, Vd, APERSEMI; `glasses` has name, nd, vd."""
    number = lambda keyword, k=0: F.coalesce(_first(keyword, k).try_cast("double"), F.lit(0.0))
    g = _children(stanzas, doc).groupBy(doc, F.col("surface").alias("i")).agg(
        F.coalesce(_first("TYPE", 0), F.lit("STANDARD")).alias("type"),
        F.max(F.col("keyword") == "STOP").alias("stop"),
        number("CURV").alias("curvature"),
        F.when(F.upper(_first("DISZ", 0)) == "INFINITY", float("inf")).otherwise(number("DISZ")).alias("D"),
        _first("GLAS", 0).alias("glass"),
        _first("GLAS", 3).try_cast("double").alias("own_nd"),
        _first("GLAS", 4).try_cast("double").alias("own_vd"),
        number("DIAM").alias("semi"),
    )
    unit = stanzas.where("keyword = 'UNIT'").groupBy(F.col(doc).alias("u_doc")).agg(F.min(F.upper(F.get("params", F.lit(0)))).alias("unit"))
    g = g.join(unit.hint("merge"), F.col(doc) == F.col("u_doc"), "left").join(glasses.select(F.col("name").alias("glass"), "nd", "vd"), "glass", "left")
    own = F.col("glass") == "___BLANK"
    known = F.col("glass").isNull() | own | F.col("nd").isNotNull()
    checks = [
        (F.col("type").isin("STANDARD", "EVENASPH", "XASPHERE"), F.concat(F.lit("unsupported surface type: "), "type")),
        (F.coalesce("unit", F.lit("MM")) == "MM", F.concat(F.lit("unsupported unit: "), "unit")),
        (known, F.concat(F.lit("unknown glass: "), "glass")),
    ]
    for okay, message in checks:
        g = g.where(F.when(~okay, _raise(message)).otherwise(True))
    shape = F.when(F.col("type") != "STANDARD", "ASPH").when(F.col("curvature") == 0, "FLAT").otherwise("SPHR")
    return g.select(
        doc,
        "i",
        F.when(F.col("stop"), "X").alias("STOP"),
        shape.alias("SHAPE"),
        F.when(F.col("curvature") != 0, 1 / F.when(F.col("curvature") != 0, F.col("curvature"))).alias("R"),
        "D",
        F.when(own, F.col("own_nd")).otherwise(F.col("nd")).alias("Nd"),
        F.when(own, F.col("own_vd")).otherwise(F.col("vd")).alias("Vd"),
        F.when(F.col("semi") != 0, F.col("semi")).alias("APERSEMI"),
    )


def aspheric(stanzas: DataFrame, doc: str, terms: int = TERMS) -> DataFrame:
    """doc, i, K, A4, A6 ... of aspheric surfaces; the terms stand in PARM 2 ... or in XDAT 4 ..."""
    at = F.get("params", F.lit(0)).try_cast("int")
    value = F.get("params", F.lit(1)).try_cast("double")
    term = lambda k: F.coalesce(F.max(F.when(((F.col("keyword") == "PARM") & (at == k + 2)) | ((F.col("keyword") == "XDAT") & (at == k + 4)), value)), F.lit(0.0))
    g = _children(stanzas, doc).groupBy(doc, F.col("surface").alias("i")).agg(_first("TYPE", 0).alias("type"), F.coalesce(_first("CONI", 0).try_cast("double"), F.lit(0.0)).alias("K"), *[term(k).alias(f"A{2 * k + 4}") for k in range(terms)])
    return g.where(F.col("type").isin("EVENASPH", "XASPHERE")).drop("type")
