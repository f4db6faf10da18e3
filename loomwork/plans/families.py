"""Queries for operator families beyond the catalogue's, each with its SQL: geometry, optics, colours, pixels, listings, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomwork.functions import columns as C
from loomwork.functions import sampling
from loomwork.operators import arrays, evaluation, joins, rank, sequences, stats, stores, tensors
from loomwork.plans.catalogue import _LOG, ORACLES, T, _log, _u, query
from loomwork.sources import files
from loomwork.streaming import ledger

_PIXELS = "SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)"


def _pixels(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    return arrays.cells(e, ["vec_id"], "a", 8)


def _at(df, *columns):
    """Grid coordinates as the SQL has them."""
    return df.select(*[F.col(c).cast("long").alias(c) if c in ("y", "x") else c for c in columns])


# arithmetic and vectors -----------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice / 100 - 9 AS b, (p_partkey % 7 - 3.5)::DOUBLE AS c FROM part),
    r AS (SELECT *, b * b - 4 * a * c AS disc FROM p), s AS (SELECT *, CASE WHEN disc >= 0 THEN sqrt(greatest(disc, 0)) ELSE 1 END AS root FROM r),
    q AS (SELECT *, -0.5 * (b + CASE WHEN b >= 0 THEN root ELSE -root END) AS q FROM s), z AS (SELECT *, q / a AS x, CASE WHEN q <> 0 THEN c / q ELSE 0 END AS y FROM q)
    SELECT p_partkey, round(least(x, y), 7) AS first, round(greatest(x, y), 7) AS second, disc >= 0 AS defined FROM z""")
def quadratic_roots(spark, d):
    r = C.quadratic_roots("p_size", F.col("p_retailprice") / 100 - 9, F.col("p_partkey") % 7 - 3.5, ordered=True)
    return T(spark, d, "part").select("p_partkey", F.round(r["first"], 7).alias("first"), F.round(r["second"], 7).alias("second"), r["defined"].alias("defined"))


@query("SELECT event_id, CASE WHEN value = 0 OR user_id % 3 = 0 THEN 0 ELSE round(value * (user_id % 3), 8) END AS product, least(value, user_id % 3) AS low, greatest(value, user_id % 3) AS high FROM events")
def guarded_pairs(spark, d):
    k = (F.col("user_id") % 3).cast("double")
    p = C.ordered_pair("value", k)
    return T(spark, d, "events").select("event_id", F.round(C.safe_mul("value", k), 8).alias("product"), p["low"].alias("low"), p["high"].alias("high"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[65 - i]::DOUBLE)), 5) AS dot, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 5) AS norm,
    round(embedding[64]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 5) AS last_unit, round(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE, 6) AS modulus FROM embeddings""")
def vector_products(spark, d):
    e = F.col("embedding")
    n = C.norm_and_direction(e)
    z = F.struct(e[0].cast("double").alias("re"), e[1].cast("double").alias("im"))
    return T(spark, d, "embeddings").select("vec_id", F.round(C.dot(e, F.reverse(e)), 5).alias("dot"), F.round(n["norm"], 5).alias("norm"), F.round(F.element_at(n["direction"], -1), 5).alias("last_unit"), F.round(C.modulus_squared(z), 6).alias("modulus"))


@query("SELECT event_id, round(value * cos(user_id / 10.0::DOUBLE), 8) AS x, round(value * sin(user_id / 10.0::DOUBLE), 8) AS y FROM events")
def from_polar(spark, d):
    p = C.from_polar("value", F.col("user_id") / 10.0)
    return T(spark, d, "events").select("event_id", F.round(p["x"], 8).alias("x"), F.round(p["y"], 8).alias("y"))


@query("""SELECT p_partkey, -3.5::DOUBLE + p_size * 0.25::DOUBLE AS world, round((p_retailprice - 100) / 0.5, 6) AS index, p_size < 25 AS inside, p_size - 3 >= 0 AND p_size + 3 <= 44 AND p_partkey % 50 - 4 >= 0 AND p_partkey % 50 + 4 <= 39 AS box,
    round(sqrt(p_size * p_size + 4.0::DOUBLE + 9.0::DOUBLE) - 20, 8) AS distance FROM part""")
def grid_transforms(spark, d):
    k = F.col("p_partkey") % 50
    ball = C.signed_ball_distance(F.col("p_size").cast("double"), F.lit(2.0), F.lit(3.0), 20.0)
    return T(spark, d, "part").select("p_partkey", C.index_to_world("p_size", -3.5, 0.25).alias("world"), F.round(C.world_to_index("p_retailprice", 100.0, 0.5), 6).alias("index"), C.in_bounds("p_size", 25).alias("inside"), C.box_inside("p_size", k, 3, 4, 45, 40).alias("box"), F.round(ball, 8).alias("distance"))


# optics ---------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS z, 1.4 + p_size / 100.0::DOUBLE AS nd, 20.0::DOUBLE + p_size AS vd FROM part),
    b AS (SELECT *, (nd - 1) / (vd * (1 / 0.4861327::DOUBLE ** 2 - 1 / 0.6562725::DOUBLE ** 2)) AS cb FROM p)
    SELECT p_partkey, round(1.5 * s / z, 10) AS na, round(nd - cb / 0.5875618::DOUBLE ** 2, 8) AS cauchy_a, round(cb, 10) AS cauchy_b, round(1 / (z - 800 + 1), 10) AS focus, round(1 / s - 1 + 800, 8) AS inverse,
        round(0.5 * s + (10 - 1) / 0.25 * 0.1, 8) AS plane_x, round(-(s - 20.25) / 7.5, 8) AS fpp, round(-1 / ((s - 25.5) / 100), 8) AS efl FROM b""")
def lens_scalars(spark, d):
    s = F.col("p_size").cast("double")
    c = C.cauchy_terms(1.4 + s / 100.0, 20.0 + s)
    plane = C.project_to_plane(10.0, 0.5 * s, 0.0, 1.0, 0.1, 0.0, 0.25)
    f = sequences.focal_scalars(F.lit(1.0), F.lit(0.0), F.lit(-7.5), s - 19.25)
    g = sequences.focal_scalars(F.lit(1.0), F.lit(0.0), (s - 25.5) / 100, F.lit(1.0))
    x = [C.numerical_aperture(s, "p_retailprice", 1.5), c["a"], c["b"], C.focus_transform("p_retailprice", 800.0), C.focus_inverse(s, 800.0), plane["x"], f["fpp"], g["efl"]]
    return T(spark, d, "part").select("p_partkey", *[F.round(v, k).alias(n) for v, k, n in zip(x, (10, 8, 10, 10, 8, 8, 8, 8), ("na", "cauchy_a", "cauchy_b", "focus", "inverse", "plane_x", "fpp", "efl"), strict=True)])


@query("""WITH p AS (SELECT p_partkey, -(0.5 + p_size / 10.0::DOUBLE) AS z FROM part), i AS (SELECT p_partkey, 1 / (1 / z + 20) AS near, 1 / (1 / -3.0::DOUBLE + 20) AS far, 1 / (1 / -1.0::DOUBLE + 20) AS f FROM p),
    n AS (SELECT p_partkey, unnest([near, far]) AS image, f FROM i), a AS (SELECT *, 0.0001::DOUBLE / (0.0001::DOUBLE + (image + 0.01) ** 2 + image * 0.2 * 0.004) AS na2 FROM n)
    SELECT p_partkey, round(max(4 * 4 * na2 * abs(f - image) / (sqrt(1 - na2) * 0.0000005)), 6) AS bound FROM a GROUP BY p_partkey""")
def sampling_bound(spark, d):
    z = -(0.5 + F.col("p_size") / 10.0)
    bound = C.sampling_bound(z, -3.0, -1.0, 20.0, -0.01, 0.01, 0.2, 0.004, 0.0000005)
    return T(spark, d, "part").select("p_partkey", F.round(bound, 6).alias("bound"))


@query("""WITH p AS (SELECT p_partkey, (p_size - 25) / 2500.0::DOUBLE AS coc FROM part), q AS (SELECT p_partkey, coc, (1 / (1 / -1.0::DOUBLE + 20) + 0.01) * 0.01 / (0.01 + coc) - 0.01 AS image FROM p)
    SELECT p_partkey, round(1 / (1 / image - 20), 7) AS z FROM q""")
def object_of_blur(spark, d):
    return T(spark, d, "part").select("p_partkey", F.round(C.object_of_blur((F.col("p_size") - 25) / 2500.0, -1.0, 20.0, -0.01, 0.01), 7).alias("z"))


@query("""WITH p AS (SELECT p_partkey, 1 + p_size / 100.0::DOUBLE AS a, 0.5 + p_size / 50.0::DOUBLE AS b, -p_size / 90.0::DOUBLE AS c, 1 - p_size / 80.0::DOUBLE AS d FROM part)
    SELECT p_partkey, round(b / a, 9) AS entrance, CASE WHEN abs(d) > 1e-12 THEN round(-b / d, 9) END AS exit FROM p""")
def pupil_positions(spark, d):
    s = F.col("p_size")
    p = sequences.pupil_positions(1 + s / 100.0, 0.5 + s / 50.0, 1 + s / 100.0, 0.5 + s / 50.0, -s / 90.0, 1 - s / 80.0)
    return T(spark, d, "part").select("p_partkey", F.round(p["entrance"], 9).alias("entrance"), F.round(p["exit"], 9).alias("exit"))


@query("SELECT p_partkey, p_size BETWEEN 5 AND 40 AND p_retailprice / p_size <= 120 AND p_partkey % 9 <> 0 AS okay FROM part")
def quality_criterion(spark, d):
    s, missing = F.col("p_size"), F.when(F.col("p_partkey") % 9 != 0, F.lit(0.0))
    return T(spark, d, "part").select("p_partkey", evaluation.meets((s, 5, 40), (F.try_divide("p_retailprice", s), None, 120), (missing, 0, 0)).alias("okay"))


@query("""WITH p AS (SELECT p_brand, p_size / 10.0::DOUBLE AS px, (p_partkey % 11) / 10.0::DOUBLE AS py, 0.0::DOUBLE AS pz, (p_partkey % 5 - 2) / 20.0::DOUBLE AS dx, (p_partkey % 7 - 3) / 20.0::DOUBLE AS dy, 1.0::DOUBLE AS dz, 1 + p_partkey % 3 AS w FROM part),
    m AS (SELECT p_brand, sum(w * px * dx) - sum(w * px) * sum(w * dx) / sum(w) + sum(w * py * dy) - sum(w * py) * sum(w * dy) / sum(w) AS cov, sum(w * dx * dx) - sum(w * dx) ** 2 / sum(w) + sum(w * dy * dy) - sum(w * dy) ** 2 / sum(w) AS var FROM p GROUP BY p_brand)
    SELECT p_brand, round(-cov / nullif(var, 0), 6) AS z FROM m""")
def best_focus(spark, d):
    k = F.col("p_partkey")
    p = T(spark, d, "part").select("p_brand", (F.col("p_size") / 10.0).alias("px"), ((k % 11) / 10.0).alias("py"), F.lit(0.0).alias("pz"), ((k % 5 - 2) / 20.0).alias("dx"), ((k % 7 - 3) / 20.0).alias("dy"), F.lit(1.0).alias("dz"), (1 + k % 3).alias("w"))
    return stats.best_focus(p, ["p_brand"], ["px", "py", "pz"], ["dx", "dy", "dz"], "w").select("p_brand", F.round("z", 6).alias("z"))


# text cells and listings ------------------------------------------------------------------------------

_FILES = "SELECT p_partkey, '/data/in/' || replace(p_brand, '#', '') || '/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '_out.png' WHEN 1 THEN '.tar.gz' ELSE '' END AS path, p_size AS length FROM part"


def _files(spark, d):
    k = F.col("p_partkey")
    end = F.when(k % 3 == 0, "_out.png").when(k % 3 == 1, ".tar.gz").otherwise("")
    path = F.concat(F.lit("/data/in/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), k.cast("string"), end)
    f = T(spark, d, "part").select("p_partkey", path.alias("path"), F.col("p_size").alias("length"))
    return f.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).withColumn("stem", C.file_stem("path"))


@query(f"SELECT p_partkey, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, '/out' || path[9:] AS moved, ('0x' || s[7:8] || s[5:6] || s[3:4] || s[1:2])::BIGINT AS seed FROM (SELECT *, sha256(path) AS s FROM ({_FILES}))")
def path_cells(spark, d):
    return _files(spark, d).select("p_partkey", "stem", C.rerooted("path", "/data/in", "/out").alias("moved"), C.text_seed("path").alias("seed"))


@query(f"SELECT p_partkey, contains(path, '.tar.gz') OR contains(path, '.png') AS known, contains(path, '_out') AS keyed FROM ({_FILES})")
def file_filters(spark, d):
    f = _files(spark, d)
    known = files.with_extensions(f, [".gz", ".png"]).select("p_partkey", F.lit(True).alias("known"))
    keyed = files.with_keyword(f, "_out").select("p_partkey", F.lit(True).alias("keyed"))
    return f.select("p_partkey").join(known, "p_partkey", "left").join(keyed, "p_partkey", "left").select("p_partkey", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("keyed", F.lit(False)).alias("keyed"))


@query(f"SELECT sum(length)::BIGINT AS n_bytes, count(*) AS n_files, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS n_folders FROM ({_FILES})")
def folder_stats(spark, d):
    return files.folder_stats(_files(spark, d)).withColumn("n_bytes", F.col("n_bytes").cast("long"))


@query(f"SELECT p_partkey, lpad((row_number() OVER (ORDER BY path) - 1)::VARCHAR, 5, '0') AS shared_name FROM ({_FILES})")
def renamed_pairs(spark, d):
    return files.renamed_pairs(_files(spark, d).select("p_partkey", "path"), ["path"], 5).select("p_partkey", "shared_name")


@query("SELECT p_partkey, 'a b' AS f0, p_size::VARCHAR AS f1, 'c' AS f2, 3 AS n, 'x y' AS t1, p_brand AS t2 FROM part")
def split_cells(spark, d):
    p = T(spark, d, "part").select("p_partkey", F.concat(F.lit("  a b\t"), F.col("p_size").cast("string"), F.lit("   c ")).alias("a"), F.concat(F.lit('key "x y"  '), F.col("p_brand")).alias("b"))
    f, t = C.split_fields("a"), C.quoted_tokens("b")
    return p.select("p_partkey", f[0].alias("f0"), f[1].alias("f1"), f[2].alias("f2"), F.size(t).alias("n"), t[1].alias("t1"), t[2].alias("t2"))


@query("""SELECT n_nationkey, t AS "table", r AS row, c AS column, CASE WHEN c = 'a' THEN n_name WHEN r = 1 THEN (n_nationkey * 2)::VARCHAR ELSE '-' END AS cell, CASE WHEN c = 'a' THEN 'string' WHEN r = 1 THEN 'int' ELSE 'null' END AS kind
    FROM nation, (VALUES ('First'), ('Second')) v(t), range(1, 3) q(r), (VALUES ('a'), ('b c')) w(c)""")
def text_tables(spark, d):
    name, number = F.replace("n_name", F.lit(" "), F.lit(" ")), (F.col("n_nationkey") * 2).cast("string")
    body = F.concat(F.lit("  a  b c\n  -----  ----\n  "), name, F.lit("\t"), number, F.lit("\n# note\n  "), name, F.lit("  -\n\n"))
    doc = T(spark, d, "nation").select("n_nationkey", F.concat(F.lit("First\n"), body, F.lit("Second\n"), body).alias("text"))
    return files.text_tables(doc, "n_nationkey", "text").select("n_nationkey", "table", F.col("row").cast("long").alias("row"), "column", "cell", "kind")


@query("SELECT n_nationkey, i AS row, n_nationkey + i * 1.5::DOUBLE AS first, (i + 2)::DOUBLE AS second FROM nation, range(1, 4) t(i)")
def matrix_text(spark, d):
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat((F.col("n_nationkey") + i * 1.5).cast("string"), F.lit("\t"), (i + 2).cast("string"))), "\n")
    doc = T(spark, d, "nation").select("n_nationkey", F.concat(F.lit("head\n"), F.lit("0 0\nDATA"), F.lit("\n"), lines).alias("text"))
    return files.matrix_text(doc, "n_nationkey", "text", "DATA").select("n_nationkey", F.col("row").cast("long").alias("row"), F.col("values")[0].alias("first"), F.col("values")[1].alias("second"))


@query("SELECT n_name AS name, 1.4 + n_nationkey / 100.0::DOUBLE AS nd, 30.0::DOUBLE + n_nationkey AS vd, 'NEW' AS catalog FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 1.4 + n_nationkey / 100.0::DOUBLE, 30.0::DOUBLE + n_nationkey, 'OLD' FROM nation WHERE n_nationkey % 2 = 1")
def glass_catalogues(spark, d):
    k = F.col("n_nationkey")
    line = F.concat(F.lit('NM "'), F.col("n_name"), F.lit('" 2 0 '), (1.4 + k / 100.0).cast("string"), F.lit(" "), (30.0 + k).cast("string"), F.lit("\n  CD 1 2\n"))
    docs = T(spark, d, "nation").groupBy(F.when(k % 2 == 0, "NEW").otherwise("OLD").alias("catalog")).agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("text"))
    return files.glass_catalogues(docs, "catalog", "text")


# colours and pixels ---------------------------------------------------------------------------------

_RGB = "SELECT vec_id, k, abs(embedding[3 * k + 1]::DOUBLE) AS r, abs(embedding[(3 * k + 1) % 64 + 1]::DOUBLE) AS g, abs(embedding[(3 * k + 2) % 64 + 1]::DOUBLE) AS b FROM embeddings, range(22) t(k)"


def _rgb(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(21).cast("long"))).alias("k"))
    return e.select("vec_id", "k", *[F.abs(F.get("embedding", ((3 * F.col("k") + j) % 64).cast("int")).cast("double")).alias(n) for j, n in enumerate("rgb")])


@query(f"""WITH p AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS s FROM ({_RGB})),
    t AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN v = r THEN (g - b) / s WHEN v = g THEN 2 + (b - r) / s ELSE 4 + (r - g) / s END / 6 AS h FROM p)
    SELECT vec_id, k, round(h - floor(h), 6) AS hue, round(s / nullif(v, 0), 6) AS saturation, round(v, 6) AS value, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM t""")
def colour_turns(spark, d):
    h = C.rgb_to_hsv("r", "g", "b")
    p = _rgb(spark, d).select("vec_id", "k", h.alias("c"))
    back = C.hsv_to_rgb("c.h", "c.s", "c.v")
    return p.select("vec_id", "k", F.round("c.h", 6).alias("hue"), F.round("c.s", 6).alias("saturation"), F.round("c.v", 6).alias("value"), *[F.round(back[n], 6).alias(n) for n in "rgb"])


@query(f"""SELECT vec_id, k, round((r - 0.5) / 0.25, 8) AS standard, round(0.5 * r + 0.25 * g + 0.25 * b, 8) AS mixed, round(least(greatest((0.5 * r + 0.25) * r + 0.1, 0), 1), 8) AS toned,
    round(least(greatest(1 / nullif(r, 0) / 10, 0), 1), 8) AS inverse, round(greatest((r - 0.1) / 0.8, 0), 8) AS level, CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS alpha FROM ({_RGB})""")
def pixel_transforms(spark, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    x = [C.standardized(r, 0.5, 0.25), arrays.linear_combination([r, g, b], [[2.0, 1.0, 1.0]], row_normalized=True)[0], arrays.tone_polynomial(r, [0.5, 0.25, 0.1]), arrays.inverse_depth(r), arrays.normalized_level(r, 0.1, 0.9)]
    return _rgb(spark, d).select("vec_id", "k", *[F.round(v, 8).alias(n) for v, n in zip(x, ("standard", "mixed", "toned", "inverse", "level"), strict=True)], arrays.black_to_transparent(r, g, b).alias("alpha"))


@query(f"""SELECT vec_id, k, CASE (k // 7 % 2) * 2 + k % 7 % 2 WHEN 0 THEN r WHEN 3 THEN b ELSE g END AS raw,
    round(least(greatest(CASE (k // 7 % 2) * 2 + k % 7 % 2 WHEN 0 THEN r / 0.5 WHEN 3 THEN b / 0.6 ELSE g END, 0), 1), 8) AS balanced FROM ({_RGB})""")
def bayer_pixels(spark, d):
    y, x = F.expr("k div 7"), F.expr("k % 7")
    raw = arrays.bayer_mosaic(y, x, F.col("r"), F.col("g"), F.col("b"))
    p = _rgb(spark, d).select("vec_id", "k", raw.alias("raw"))
    return p.select("vec_id", "k", "raw", F.round(arrays.white_balanced(F.col("raw"), y, x, (0.5, 1.0, 0.6)), 8).alias("balanced"))


@query(f"SELECT a.vec_id, a.y, a.x, round(a.v + coalesce(b.v, 0), 6) AS value FROM ({_PIXELS}) a LEFT JOIN ({_PIXELS}) b ON a.vec_id = b.vec_id AND a.y = b.y + 3 AND a.x = b.x - 2")
def scatter_add(spark, d):
    p = _pixels(spark, d)
    return _at(arrays.scatter_add(p, p, ["vec_id"], 3, -2, 8, 8).withColumn("value", F.round("value", 6)), "vec_id", "y", "x", "value")


@query(f"SELECT vec_id, y, x, v AS value FROM ({_PIXELS})")
def unblocked(spark, d):
    return _at(arrays.unblocks(arrays.blocks(_pixels(spark, d), ["vec_id"], 4, 2), ["vec_id"], 4, 2), "vec_id", "y", "x", "value")


@query(f"WITH p AS (SELECT vec_id // 4 AS image, vec_id % 4 AS layer, y, x, v FROM ({_PIXELS})) SELECT image, layer, count(*) AS n FROM p WHERE (image, layer) IN (SELECT (image, layer) FROM p GROUP BY image, layer HAVING max(v) > 0.25) GROUP BY 1, 2")
def visible_layers(spark, d):
    p = _pixels(spark, d).select(F.expr("vec_id div 4").alias("image"), (F.col("vec_id") % 4).alias("layer"), "y", "x", "value")
    return arrays.visible_layers(p, ["image"], "layer", "value", 0.25).groupBy("image", "layer").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT vec_id // 2 AS image, y + 4 * (vec_id % 2) AS y, x, v FROM ({_PIXELS})) SELECT image, y, x, round(avg(v), 6) AS value FROM p GROUP BY 1, 2, 3")
def stitched(spark, d):
    p = _pixels(spark, d).select(F.expr("vec_id div 2").alias("image"), (F.col("y") + 4 * (F.col("vec_id") % 2)).alias("y"), "x", "value")
    return _at(sequences.stitched(p, ["image"], "y", "x", "value").withColumn("value", F.round("value", 6)), "image", "y", "x", "value")


@query("""WITH g AS (SELECT y, x, exp(-0.5 * ((y - 3.25) ** 2 * 3 - 2 * (y - 3.25) * (x - 2.5) * 0.5 + (x - 2.5) ** 2 * 2) / 5.75) AS e FROM range(7) a(y), range(7) b(x)) SELECT y, x, round(e / (SELECT sum(e) FROM g), 10) AS value FROM g""")
def gaussian_kernel(spark, d):
    return arrays.gaussian_kernel(7, 0.25, -0.5, 2.0, 0.5, 3.0, spark).select("y", "x", F.round("value", 10).alias("value"))


@query("SELECT l_orderkey, list(l_quantity ORDER BY (l_linenumber, l_quantity, l_partkey))[1] AS first, list(l_quantity ORDER BY (l_linenumber, l_quantity, l_partkey))[2] AS second, count(*)::INT AS n FROM lineitem GROUP BY 1")
def stacked_rows(spark, d):
    x = T(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_quantity", "l_partkey"))
    s = arrays.stacked(x, ["l_orderkey"], "o", ["l_quantity", "l_partkey"]).withColumn("n", F.size("l_quantity"))
    first, second = arrays.taken(s, ["l_quantity"], 0), arrays.taken(s, ["l_quantity"], 1)
    return first.select("l_orderkey", F.col("l_quantity").alias("first"), "n").join(second.select("l_orderkey", F.col("l_quantity").alias("second")), "l_orderkey")


# image kernels --------------------------------------------------------------------------------------


def _image(df, column):
    return df.select("vec_id", F.posexplode(column).alias("p", "value")).select("vec_id", F.expr("cast(p div 8 AS bigint)").alias("y"), (F.col("p") % 8).cast("long").alias("x"), F.round("value", 5).alias("value"))


@query(f"""WITH k AS (SELECT i, j, ([1, 2, 3][i + 1] * [2, 0, 1][j + 1])::DOUBLE / 16 AS w FROM range(3) a(i), range(3) b(j))
    SELECT o.vec_id, o.y, o.x, round(sum(w * s.v), 5) AS value FROM ({_PIXELS}) o, k JOIN ({_PIXELS}) s ON s.vec_id = o.vec_id AND s.y = o.y + 1 - i AND s.x = o.x + 1 - j GROUP BY 1, 2, 3""")
def convolved_image(spark, d):
    kernel = np.outer([1, 2, 3], [2, 0, 1]) / 16.0
    return _image(T(spark, d, "embeddings").select("vec_id", tensors.convolved("embedding", kernel, 8, 8).alias("image")), "image")


@query(f"""WITH w AS (SELECT * FROM (VALUES (1, 0, 0.75 * 0.5), (1, -1, 0.75 * 0.5), (2, 0, 0.25 * 0.5), (2, -1, 0.25 * 0.5)) t(oy, ox, w))
    SELECT o.vec_id, o.y, o.x, round(coalesce(sum(w::DOUBLE * s.v), 0), 5) AS value FROM ({_PIXELS}) o CROSS JOIN w LEFT JOIN ({_PIXELS}) s ON s.vec_id = o.vec_id AND s.y = o.y - oy AND s.x = o.x - ox GROUP BY 1, 2, 3""")
def shifted_image(spark, d):
    return _image(T(spark, d, "embeddings").select("vec_id", tensors.shifted("embedding", 8, 8, 1.25, -0.5).alias("image")), "image")


@query(f"""WITH p AS ({_PIXELS}), k AS (SELECT i, j, ([1, 2, 1][i + 1] * [1, 0, -1][j + 1])::DOUBLE AS gx, ([1, 0, -1][i + 1] * [1, 2, 1][j + 1])::DOUBLE AS gy FROM range(3) a(i), range(3) b(j)),
    s AS (SELECT o.vec_id, o.y, o.x, sum(gx * q.v) AS gx, sum(gy * q.v) AS gy FROM p o, k JOIN p q ON q.vec_id = o.vec_id AND q.y = CASE WHEN abs(o.y + i - 1) > 7 THEN 6 ELSE abs(o.y + i - 1) END AND q.x = CASE WHEN abs(o.x + j - 1) > 7 THEN 6 ELSE abs(o.x + j - 1) END GROUP BY 1, 2, 3)
    SELECT vec_id, round(sum(sqrt(gx * gx + gy * gy)), 3) AS score FROM s GROUP BY 1""")
def gradient_score_3(spark, d):
    return T(spark, d, "embeddings").select("vec_id", F.round(tensors.gradient_score("embedding", 8, 8, 3), 3).alias("score"))


_SSIM = f"""WITH e AS (SELECT i, exp(-((i - 3) ** 2) / 4.5) AS e FROM range(7) t(i)), g AS (SELECT i, e / (SELECT sum(e) FROM e) AS g FROM e),
    p AS (SELECT a.vec_id, a.y, a.x, a.v AS u, b.v FROM ({_PIXELS}) a JOIN ({_PIXELS}) b ON a.vec_id = b.vec_id AND a.y = 7 - b.y AND a.x = 7 - b.x),
    m AS (SELECT vec_id, oy, ox, sum(w * u) AS mu, sum(w * v) AS mv, sum(w * u * u) AS uu, sum(w * v * v) AS vv, sum(w * u * v) AS uv FROM (SELECT p.*, oy, ox, gi.g * gj.g AS w FROM p, range(2) r(oy), range(2) c(ox), g gi, g gj WHERE gi.i = y - oy AND gj.i = x - ox) GROUP BY 1, 2, 3)
    SELECT vec_id, round(avg((2 * mu * mv + 0.0001) * (2 * (uv - mu * mv) + 0.0009) / ((mu * mu + mv * mv + 0.0001) * (uu - mu * mu + vv - mv * mv + 0.0009))), {{digits}}) AS ssim FROM m GROUP BY 1"""


@query(_SSIM.format(digits=5))
def ssim_of_turned(spark, d):
    e = T(spark, d, "embeddings").withColumn("turned", F.reverse("embedding"))
    return e.select("vec_id", F.round(tensors.ssim("embedding", "turned", 8, 8), 5).alias("ssim"))


def _gradient_sql(smooth: list[int], slope: list[int]) -> str:
    """Sums of gradient magnitudes of images mirrored about their edges."""
    n = len(smooth)
    edge = lambda c, i: f"7 - abs(7 - abs(o.{c} + {i} - {n // 2}))"
    return f"""SELECT vec_id, sum(sqrt(gx * gx + gy * gy)) AS score FROM (SELECT o.vec_id, o.y, o.x, sum(({smooth}[i + 1] * {slope}[j + 1])::DOUBLE * q.v) AS gx, sum(({slope}[i + 1] * {smooth}[j + 1])::DOUBLE * q.v) AS gy
        FROM ({_PIXELS}) o, range({n}) a(i), range({n}) b(j) JOIN ({_PIXELS}) q ON q.vec_id = o.vec_id AND q.y = {edge('y', 'i')} AND q.x = {edge('x', 'j')} GROUP BY 1, 2, 3) GROUP BY 1"""


# two queries of the catalogue that are made from the same kernels
ORACLES["ssim"] = _SSIM.format(digits=6)
ORACLES["gradient_score"] = f"SELECT a.vec_id, round(a.score, 4) AS score_k03, round(b.score, 4) AS score_k07 FROM ({_gradient_sql([1, 2, 1], [1, 0, -1])}) a JOIN ({_gradient_sql([1, 6, 15, 20, 15, 6, 1], [1, 4, 5, 0, -5, -4, -1])}) b ON a.vec_id = b.vec_id"


@query(f"""WITH p AS (SELECT a.vec_id, a.y, a.x, a.v - b.v AS v FROM ({_PIXELS}) a JOIN ({_PIXELS}) b ON a.vec_id = b.vec_id AND a.y = 7 - b.y AND a.x = 7 - b.x),
    f AS (SELECT vec_id, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im FROM p, range(8) a(ky), range(5) b(kx) GROUP BY 1, 2, 3)
    SELECT vec_id, round((avg(abs(re)) + avg(abs(im))) / 2, 4) AS loss FROM f GROUP BY 1""")
def spectral_loss(spark, d):
    e = T(spark, d, "embeddings").withColumn("turned", F.reverse("embedding"))
    return e.select("vec_id", F.round(tensors.spectral_loss("embedding", "turned", 8, 8), 4).alias("loss"))


@query("SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem WHERE l_discount > 0.02 GROUP BY 1")
def least_squares_line(spark, d):
    x = T(spark, d, "lineitem").withColumn("one", F.lit(1.0)).withColumn("kept", F.col("l_discount") > 0.02)
    g = tensors.masked_least_squares(x, ["l_returnflag"], ["one", "l_quantity"], "l_extendedprice", "kept")
    return g.select("l_returnflag", F.round(F.col("coefficients")[0], 2).alias("intercept"), F.round(F.col("coefficients")[1], 3).alias("slope"))


# evaluation and names ---------------------------------------------------------------------------------


@query("""SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 'nan'::DOUBLE ELSE round(m, 6) END AS mse, CASE WHEN vec_id % 6 = 0 THEN 'nan'::DOUBLE ELSE round(20 * log10(1 / sqrt(m)), 4) END AS psnr
    FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - embedding[65 - i]::DOUBLE, 2))) / 64 AS m FROM embeddings)""")
def evaluated_pairs(spark, d):
    e = T(spark, d, "embeddings").withColumn("truth", F.when(F.col("vec_id") % 6 == 0, F.slice("embedding", 1, 9)).otherwise(F.reverse("embedding")))
    mse = stats.mean_squared_error(F.col("embedding"), F.col("truth"))
    r = evaluation.evaluated(e, "embedding", "truth", {"mse": mse, "psnr": stats.psnr(mse)})
    return r.select("vec_id", F.round("mse", 6).alias("mse"), F.round("psnr", 4).alias("psnr"))


@query("""WITH b AS (SELECT p_partkey + CASE WHEN p_partkey % 40 = 0 THEN 1000000 ELSE 0 END AS p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'other' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size FROM part),
    j AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, a.p_partkey IS NULL AS na, b.p_partkey IS NULL AS nb, a.p_brand AS a1, b.p_brand AS b1, a.p_size::VARCHAR AS a2, b.p_size::VARCHAR AS b2 FROM part a FULL JOIN b ON a.p_partkey = b.p_partkey)
    SELECT p_partkey, 'p_brand' AS column, CASE WHEN na THEN 'added' WHEN nb THEN 'missing' ELSE 'changed' END AS status, a1 AS old, b1 AS new FROM j WHERE na OR nb OR a1 IS DISTINCT FROM b1
    UNION ALL SELECT p_partkey, 'p_size', CASE WHEN na THEN 'added' WHEN nb THEN 'missing' ELSE 'changed' END, a2, b2 FROM j WHERE na OR nb OR a2 IS DISTINCT FROM b2""")
def assignment_diff(spark, d):
    a, k = T(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("p_partkey")
    b = a.select((k + F.when(k % 40 == 0, 1000000).otherwise(0)).alias("p_partkey"), F.when(k % 9 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 7 != 0, F.col("p_size")).alias("p_size"))
    return joins.assignment_diff(a, b, "p_partkey", ["p_brand", "p_size"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '/abs/' || c_custkey WHEN n_name IS NULL THEN NULL ELSE '/w/' || n_name END AS path
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN -1 ELSE c_nationkey END AS k FROM customer) LEFT JOIN nation ON n_nationkey = k""")
def resolved_names(spark, d):
    k = F.col("c_custkey")
    own = T(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit("/abs/"), k.cast("string"))).when(k % 5 == 1, "none").otherwise(F.col("c_nationkey").cast("string")).alias("given"))
    known = T(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.concat(F.lit("/w/"), F.col("n_name")).alias("target"))
    return joins.resolved_names(own, "given", known, "name", "target", "path").select("c_custkey", "path")


@query("SELECT n_nationkey, '/lq/' || n_name || '_x2.png' AS low, '/gt/' || n_name || '.png' AS high FROM nation")
def manifest_pairs(spark, d):
    lines = T(spark, d, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.lit(".png (480,480,3)")).alias("value"))
    return files.manifest_pairs(lines, "value", "/lq", "/gt", "{}_x2").select("n_nationkey", "low", "high")


@query("""WITH c AS (SELECT p_brand, p_size, dense_rank() OVER (ORDER BY p_brand, p_size) - 1 AS code, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY p_brand, p_size)
    SELECT p_partkey, code, first, n FROM part JOIN c USING (p_brand, p_size)""")
def dictionary_codes(spark, d):
    p = T(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    words = rank.dictionary(p, ["p_brand", "p_size"], "p_partkey")
    return rank.expanded(p, words, ["p_brand", "p_size"]).select("p_partkey", "code", "first", "n")


@query("SELECT s_suppkey AS unit, cycle, s_nationkey * 3 + cycle AS item FROM supplier, range(3) t(cycle) WHERE cycle < s_nationkey % 4")
def unit_cycles(spark, d):
    units = T(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), "s_nationkey", F.least(F.lit(3), F.col("s_nationkey") % 4).alias("n"))
    return ledger.cycles(units, "n").select("unit", "cycle", (F.col("s_nationkey") * 3 + F.col("cycle")).alias("item"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey WHEN n_nationkey % 2 <> 0 THEN 100 WHEN n_nationkey % 3 <> 0 THEN least(n_nationkey + 1, 7) END::BIGINT AS total FROM nation")
def expected_totals(spark, d):
    k = F.col("n_nationkey").cast("long")
    n = T(spark, d, "nation").select("n_nationkey", F.when(k % 5 != 0, k).alias("own"), F.when(k % 2 != 0, F.lit(100).cast("long")).alias("source"), F.array(k + 1, F.when(k % 3 != 0, F.lit(7).cast("long"))).alias("needs"))
    return n.select("n_nationkey", stats.expected_total(n, "own", "source", "needs").alias("total"))


@query("SELECT 'a' AS metric, avg(CASE WHEN p_size % 3 = 0 THEN p_size END)::DOUBLE AS value FROM part UNION ALL SELECT 'b', round(avg(p_retailprice), 6) FROM part")
def parsed_means(spark, d):
    s = F.col("p_size")
    p = T(spark, d, "part").select(F.when(s % 3 == 0, s.cast("string")).when(s % 3 == 1, "n/a").otherwise("nan").alias("a"), F.col("p_retailprice").alias("b"))
    return stats.parsed_means(p, ["a", "b"]).select("metric", F.when(F.col("metric") == "b", F.round("value", 6)).otherwise(F.col("value")).alias("value"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS t, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN coalesce((SELECT max(s_acctbal) FROM supplier WHERE s_suppkey = p_partkey), 0) ELSE coalesce((SELECT max(s_acctbal) FROM supplier WHERE s_suppkey = p_partkey), 0) END AS copied FROM part")
def copied_values(spark, d):
    p = T(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(0.0).alias("t"), F.lit(-1.0).alias("copied"))
    old = T(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("copied"), F.lit(1).alias("o"))
    return joins.copy_matching(p.drop("copied"), old, ["p_partkey"], "copied", "o").select("t", "p_partkey", "copied")


# stores and ledger ------------------------------------------------------------------------------------


@query("""SELECT '{' || string_agg('"' || r_regionkey || '":"' || r_name || '"', ',' ORDER BY r_regionkey::VARCHAR) || '}' AS json FROM region""")
def json_object(spark, d):
    return stores.as_json_object(T(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value")))


@query("SELECT rpad(n_name, greatest((SELECT max(length(n_name)) FROM nation), 6)::INT, ' ') AS n_name, rpad(n_nationkey::VARCHAR, greatest((SELECT max(length(n_nationkey::VARCHAR)) FROM nation), 11)::INT, ' ') AS n_nationkey FROM nation")
def aligned_table(spark, d):
    return stores.aligned(T(spark, d, "nation").select("n_name", "n_nationkey"))


@query("SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#12'")
def affected_rows(spark, d):
    return stores.affected(T(spark, d, "part"), "p_brand", "Brand#12")


@query("SELECT p_brand, p_size FROM part WHERE false")
def cleared_table(spark, d):
    return stores.cleared(T(spark, d, "part").select("p_brand", "p_size"))


@query("SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def set_remove(spark, d):
    x = T(spark, d, "lineitem")
    return stores.remove(stores.as_set(x, "l_partkey"), stores.as_set(x.where("l_quantity > 45"), "l_partkey"))


@query(f"WITH l AS (SELECT stage, item, arg_max(status, moment) AS s FROM ({_LOG}) GROUP BY 1, 2) SELECT item FROM l WHERE stage = '1' AND s IN ('done', 'skipped')")
def ledger_processable(spark, d):
    return ledger.processable(_log(spark, d), "1")


@query(f"WITH l AS (SELECT stage, item, arg_max(status, moment) AS s FROM ({_LOG}) GROUP BY 1, 2) SELECT stage, item, 'skipped' AS status, 7::BIGINT AS moment FROM l WHERE stage = '2' AND s = 'failed'")
def ledger_skip_failed(spark, d):
    return ledger.skip_all_failed(_log(spark, d), "2", 7).select("stage", "item", "status", F.col("at").alias("moment"))


@query(f"""WITH l AS (SELECT stage, item, arg_max(status, moment) AS s FROM ({_LOG}) GROUP BY 1, 2) SELECT NOT EXISTS (SELECT 1 FROM l WHERE stage = '0' AND s = 'done'
    AND item NOT IN (SELECT item FROM l WHERE stage = '2' AND s IN ('done', 'skipped'))) AS complete""")
def ledger_complete(spark, d):
    return ledger.is_complete(_log(spark, d), ["0"], "2")


# sampling ---------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT p_partkey, 2 * {_u('1', 'p_partkey')} - 1 AS a, 2 * {_u('2', 'p_partkey')} - 1 AS b FROM part), t AS (SELECT *, CASE WHEN abs(a) > abs(b) THEN a ELSE b END AS r, CASE WHEN abs(a) > abs(b) THEN pi() / 4 * (b / a) WHEN b <> 0 THEN pi() / 2 - pi() / 4 * (a / b) ELSE 0 END AS f FROM p)
    SELECT p_partkey, round(r * cos(f), 9) AS x, round(r * sin(f), 9) AS y FROM t""")
def square_to_disk(spark, d):
    p = sampling.square_to_disk(C.uniform(F.lit(1), "p_partkey"), C.uniform(F.lit(2), "p_partkey"))
    return T(spark, d, "part").select("p_partkey", F.round(p["x"], 9).alias("x"), F.round(p["y"], 9).alias("y"))


@query(f"""WITH p AS (SELECT p_partkey, (1.0::DOUBLE * 4 + 0.25 * 2) / 2 AS ey, (0.5::DOUBLE * 4 + 1.5 * 2) / 2 AS ex, p_size + 2 AS h FROM part)
    SELECT p_partkey, round(CASE WHEN h - 1 - ey >= ey THEN ey + (h - 1 - 2 * ey) * {_u('6', 'p_partkey', chr(39) + 'y' + chr(39))} ELSE (h - 1) / 2.0 END, 9) AS y, round(ex + (31 - 2 * ex) * {_u('6', 'p_partkey', chr(39) + 'x' + chr(39))}, 9) AS x FROM p""")
def patch_centres(spark, d):
    c = sampling.patch_centre(F.col("p_size") + 2, F.lit(32), (5, 3), (F.lit(1.0), F.lit(0.25), F.lit(0.5), F.lit(1.5)), F.lit(6), "p_partkey")
    return T(spark, d, "part").select("p_partkey", F.round(c["y"], 9).alias("y"), F.round(c["x"], 9).alias("x"))


@query("SELECT rows, columns FROM (SELECT i AS rows, ceil(37.0 / i)::BIGINT AS columns FROM range(1, 38) t(i)) WHERE abs(ln(columns / rows::DOUBLE / 1.5)) <= 4 ORDER BY abs(ln(columns / rows::DOUBLE / 1.5)) + (rows * columns - 37) / 37.0::DOUBLE, rows LIMIT 1")
def best_grid(spark, d):
    return rank.best_grid(37, 1.5, spark).select("rows", "columns")
