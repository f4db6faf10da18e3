"""Queries that write files from the tables, read them back and are checked against the tables, and the lens geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import columns as C
from loomwork.operators import joins, lookup, sequences, stats, stores, tensors
from loomwork.plans.catalogue import T, query
from loomwork.plans.extended import _stored_tensors
from loomwork.sources import files, prescriptions
from loomwork.sources import tensors as store
from loomwork.sources.shared import shared_folder
from loomwork.streaming import ledger

# tables and keys ----------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal, c_acctbal > 5000 AS rich FROM customer")
def table_from_csv(spark, d):
    path = shared_folder(spark, "csv")
    stores.to_csv(T(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") > 5000).alias("rich")), path)
    return files.table_csv(spark, path, {"c_custkey": int, "c_name": str, "c_acctbal": float, "rich": bool})


@query("SELECT s_suppkey, s_name, s_acctbal, s_nationkey % 2 = 0 AS even FROM supplier")
def table_from_json(spark, d):
    """Each nation's suppliers are one JSON array in a file of its own lines."""
    path = shared_folder(spark, "json")
    s = T(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", (F.col("s_nationkey") % 2 == 0).alias("even"))
    stores.as_json_rows(s, ["s_suppkey"]).write.text(path)
    return files.table_json(spark, path, {"s_suppkey": int, "s_name": str, "s_acctbal": float, "even": bool})


@query("SELECT 'k' || p_partkey AS key, p_name || ', ' || p_type AS value FROM part")
def key_values_from_csv(spark, d):
    path = shared_folder(spark, "keys")
    p = T(spark, d, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.concat_ws(", ", "p_name", "p_type").alias("value"))
    stores.to_csv(p, path)
    return stores.ordered_items(files.key_value_csv(spark, path))


@query("SELECT s_name AS key, s_suppkey::VARCHAR AS value FROM supplier")
def key_values_from_json(spark, d):
    path = shared_folder(spark, "map")
    stores.as_json_object(T(spark, d, "supplier").select(F.col("s_name").alias("key"), F.col("s_suppkey").cast("string").alias("value"))).write.text(path)
    return stores.ordered_items(files.key_value_json(spark, path))


@query("SELECT DISTINCT p_name AS value FROM part")
def set_from_json(spark, d):
    path = shared_folder(spark, "set")
    stores.as_json_list(stores.as_set(T(spark, d, "part"), "p_name")).write.text(path)
    return files.set_json(spark, path)


@query("SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice, p_brand FROM part")
def matched_schema(spark, d):
    kinds = {"p_partkey": int, "p_size": int, "p_retailprice": float, "p_brand": str}
    lookup.table_schema(kinds, "p_partkey")
    return lookup.match_schema(T(spark, d, "part").select("p_brand", "p_size", "p_retailprice", "p_partkey"), kinds)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, upper(s_name), -s_acctbal FROM supplier")
def inserted_rows(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), F.upper("s_name").alias("s_name"), (-F.col("s_acctbal")).alias("s_acctbal"))
    return stores.insert(s, new, "s_suppkey")


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_acctbal < 0")
def refilled_table(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), "c_acctbal")
    return stores.insert(stores.cleared(c.select("k", "v")), c.where("c_acctbal < 0").select("k", "v"), "k")


@query("SELECT lpad(vec_id::VARCHAR, 9, '0') AS key FROM embeddings WHERE lpad(vec_id::VARCHAR, 9, '0') LIKE '0000002%'")
def tensor_keys(spark, d):
    return files.keys_with_prefix(store.read_tensors(spark, _stored_tensors(spark, d), prefix="0000002", data=False), "0000002")


# listings and lists -------------------------------------------------------------------------------------


def _text_files(spark, d):
    """One text file for each language and source, whose lines are the documents in order, white space as one blank."""
    path = shared_folder(spark, "texts")
    t = T(spark, d, "documents").select("lang", "source", "doc_id", F.trim(F.regexp_replace("text", r"[\x00-\x20]+", " ")).alias("value"))
    t.repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id").select("lang", "source", F.coalesce("value", F.lit("")).alias("value")).write.partitionBy("lang", "source").text(path)
    return path


_TEXTS = r"SELECT lang, source, string_agg(trim(regexp_replace(text, '[\x00-\x20]+', ' ', 'g')), chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY lang, source"


@query(f"SELECT lang, source, strlen(t) AS length FROM ({_TEXTS})")
def listed_files(spark, d):
    """The folders' files, of which each folder has one."""
    part = lambda k: F.regexp_extract("path", f"{k}=([^/]*)/", 1)
    listed = files.with_extensions(files.listing(spark, _text_files(spark, d), "*.txt"), [".txt"])
    listed = listed.withColumns({"lang": part("lang"), "source": part("source")}).withColumn("folder", F.concat_ws("/", "lang", "source"))
    once = files.unique_names(listed, "folder").select(F.col("path").alias("once"))
    return listed.join(once, F.col("path") == F.col("once")).select("lang", "source", "length")


@query(f"SELECT lang, source, sha256(t) AS digest FROM ({_TEXTS})")
def decoded_files(spark, d):
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(_text_files(spark, d))
    part = lambda k: F.regexp_extract("path", f"{k}=([^/]*)/", 1)
    return f.select(part("lang").alias("lang"), part("source").alias("source"), F.sha2(files.decoded("content").cast("binary"), 256).alias("digest"))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name UNION ALL SELECT 'whole ' || p_name || CASE WHEN p_size > 25 THEN '  # ' || p_brand ELSE '' END, count(*) FROM part GROUP BY 1")
def line_lists(spark, d):
    """Names with remarks and blank lines, read with and without remarks."""
    path = shared_folder(spark, "lines")
    remark = F.when(F.col("p_size") > 25, F.concat(F.lit("  # "), "p_brand")).otherwise("")
    lines = T(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("  "), "p_name", remark), F.lit("   "), F.lit("# only a remark"))).alias("value"))
    lines.write.text(path)
    names = files.commented_list(spark, path)
    whole = files.line_list(spark, path).where("value NOT LIKE '#%'").select(F.concat(F.lit("whole "), "value").alias("value"))
    return names.unionByName(whole).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS model, p_name AS weight, p_partkey::VARCHAR AS dataset FROM part WHERE p_size % 5 <> 0")
def job_lists(spark, d):
    path = shared_folder(spark, "jobs")
    row = F.concat_ws(" , ", "p_brand", "p_name", F.col("p_partkey").cast("string"))
    line = F.when(F.col("p_size") % 5 != 0, row).when(F.col("p_size") % 2 == 0, F.concat(F.lit("# "), row)).when(F.col("p_size") % 3 == 0, "Model,weight,dataset").otherwise(F.concat(row, F.lit(",more")))
    T(spark, d, "part").select(line.alias("value")).write.text(path)
    return files.job_rows(spark.read.text(path))


@query("SELECT o_custkey % 10 AS tens, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def streamed_runs(spark, d):
    """Two runs over a folder that grows between them; each file is worked on once."""
    folder, sink, checkpoint = (shared_folder(spark, x) for x in ("orders", "orders-out", "orders-checkpoint"))
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    for k in range(2):
        o.where(F.col("o_orderkey") % 2 == k).write.mode("append").parquet(folder)
        ledger.run_once(spark, folder, "o_orderkey long, o_custkey long, o_totalprice double", lambda df: df.select((F.col("o_custkey") % 10).alias("tens"), "o_totalprice"), sink, checkpoint).awaitTermination()
    out = spark.read.schema("tens long, o_totalprice double").parquet(sink)
    return out.groupBy("tens").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# cells, lenses, rays --------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN value * 1e5 WHEN 2 THEN value / 1e8 WHEN 3 THEN 'inf'::DOUBLE WHEN 4 THEN 0 ELSE value / 67 END AS v FROM events)
    SELECT event_id, CASE WHEN v IS NULL THEN '-' WHEN isinf(v) THEN 'INF' WHEN v = 0 THEN '0' WHEN abs(v) < 1e-4 OR abs(v) >= 1e6 THEN printf('%.5E', v) ELSE regexp_replace(regexp_replace(printf('%.5f', v), '0+$', ''), '\\.$', '') END AS cell FROM v""")
def formatted_cells(spark, d):
    k = F.col("event_id") % 7
    v = F.when(k == 0, None).when(k == 1, F.col("value") * 1e5).when(k == 2, F.col("value") / 1e8).when(k == 3, float("inf")).when(k == 4, 0.0).otherwise(F.col("value") / 67)
    return T(spark, d, "events").select("event_id", C.format_cell(v).alias("cell"))


def _lenses(spark, d, parts=None, doc="p_partkey"):
    """Stanzas of one lens for each part: a stop, an aspheric surface of a catalogue glass, a surface of a glass of its own.

    `parts` may bring the parts with a document name of their own. Lines whose number is null are left out.
    """
    line = lambda before, x, after="": F.coalesce(F.concat(F.lit(f"  {before}"), x.cast("string"), F.lit(f"{after}\n")), F.lit(""))
    size = F.col("p_size")
    asphere = F.concat(F.lit("SURF 1\n  TYPE EVENASPH\n"), line("CURV 0.0", size, "5"), line("DISZ ", size), line("GLAS G", F.col("p_partkey") % 3, " 0 0"), F.lit("  CONI -1.5\n  PARM 2 0.25\n"), line("PARM 3 0.0", size))
    own = F.concat(F.lit("SURF 2\n  CURV 0\n  DISZ 2.5\n  GLAS ___BLANK 1 0 1.6 50\n"), line("DIAM ", size, " 1"))
    text = F.concat(F.lit("UNIT MM X\nSURF 0\n  STOP\n  DISZ INFINITY\n"), asphere, own)
    docs = (T(spark, d, "part") if parts is None else parts).select(doc, text.alias("text"))
    glass = T(spark, d, "region").where("r_regionkey < 3").select(F.concat(F.lit("NM G"), F.col("r_regionkey").cast("string"), F.lit(" 2 0 1.5"), F.col("r_regionkey").cast("string"), F.lit(" 6"), F.col("r_regionkey").cast("string"), F.lit("\n")).alias("text"), F.col("r_regionkey").alias("doc"))
    return files.stanza_lines(docs, doc, "text"), files.glass_rows(files.stanza_lines(glass, "doc", "text"))


_LENSES = """SELECT p_partkey, 0 AS i, 'X' AS STOP, 'FLAT' AS SHAPE, NULL::DOUBLE AS R, 'inf'::DOUBLE AS D, NULL::DOUBLE AS Nd, NULL::DOUBLE AS Vd, NULL::DOUBLE AS APERSEMI, 0.0::DOUBLE AS z, NULL::DOUBLE AS K, NULL::DOUBLE AS A4, NULL::DOUBLE AS A6 FROM part
    UNION ALL SELECT p_partkey, 1, NULL, 'ASPH', round(1 / ('0.0' || p_size || '5')::DOUBLE, 7), p_size, ('1.5' || p_partkey % 3)::DOUBLE, ('6' || p_partkey % 3)::DOUBLE, NULL, 0, -1.5, 0.25, ('0.0' || p_size)::DOUBLE FROM part
    UNION ALL SELECT p_partkey, 2, NULL, 'FLAT', NULL, 2.5, 1.6, 50, p_size, p_size, NULL, NULL, NULL FROM part"""


@query(_LENSES)
def lens_surfaces(spark, d):
    """A part is a lens, whatever its key: parts that are equal in key and size are read once and come as often as they are there."""
    parts = T(spark, d, "part").groupBy("p_partkey", "p_size").agg(F.count("*").alias("n"))
    stanzas, glasses = _lenses(spark, d, parts.withColumn("lens", F.struct("p_partkey", "p_size", "n")), "lens")
    s = prescriptions.surfaces(stanzas, "lens", glasses)
    out = joins.surfaces_with_positions(s, prescriptions.aspheric(stanzas, "lens", 2), "lens")
    # a line that is left out counts as 0, and a diameter of 0 as none: as the SQL has it, an unknown size stays unknown and 0 stays 0
    known = lambda c, i: F.when((F.col("i") != i) | F.col("lens.p_size").isNotNull(), F.col(c)).alias(c)
    semi = F.when((F.col("i") == 2) & (F.col("lens.p_size") == 0), 0.0).otherwise(F.col("APERSEMI")).alias("APERSEMI")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lens.n"))))
    return out.select("lens.p_partkey", "i", "STOP", "SHAPE", F.round("R", 7).alias("R"), known("D", 1), "Nd", "Vd", semi, known("z", 2), "K", "A4", known("A6", 1))


def _number(c):
    return f"CASE WHEN {c} IS NULL THEN '-' WHEN isinf({c}) THEN 'INF' WHEN {c} = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.5f', {c}), '0+$', ''), '\\.$', '') END"


_COLUMNS = [("SURFACES", 0, "true", ["i", "STOP", "SHAPE", "R", "D", "Nd", "Vd", "APERSEMI"]), ("ASPHERIC", 1, "i = 1", ["i", "K", "A4", "A6"])]
_CELLS = " UNION ALL ".join(
    f"SELECT p_partkey, '{t}' AS t, {p} AS place, i AS line, {k} AS k, '{c}' AS head, {f'coalesce({c}::VARCHAR, chr(45))' if c in ('i', 'STOP', 'SHAPE') else _number(c)} AS text, {str(c not in ('STOP', 'SHAPE')).lower()} AS num FROM s WHERE {when}" for t, p, when, cs in _COLUMNS for k, c in enumerate(cs)
)


@query(f"""WITH s AS ({_LENSES}), c AS ({_CELLS}), w AS (SELECT p_partkey, t, k, head, greatest(max(length(text)), length(head))::INT AS wide FROM c GROUP BY 1, 2, 3, 4),
    h AS (SELECT p_partkey, t, '  ' || string_agg(rpad(head, wide, ' '), '  ' ORDER BY k) AS head FROM w GROUP BY 1, 2),
    l AS (SELECT c.p_partkey, c.t, place, line, '  ' || string_agg(CASE WHEN num THEN lpad(text, wide, ' ') ELSE rpad(text, wide, ' ') END, '  ' ORDER BY c.k) AS row FROM c JOIN w ON w.p_partkey = c.p_partkey AND w.t = c.t AND w.k = c.k GROUP BY 1, 2, 3, 4),
    b AS (SELECT l.p_partkey, l.t, place, l.t || chr(10) || head || chr(10) || '  ' || repeat('-', length(head) + 8) || chr(10) || string_agg(row, chr(10) ORDER BY line) || chr(10) AS text FROM l JOIN h ON h.p_partkey = l.p_partkey AND h.t = l.t GROUP BY l.p_partkey, l.t, place, head)
    SELECT p_partkey, string_agg(text, chr(10) ORDER BY place) AS text FROM b GROUP BY p_partkey""")
def lens_texts(spark, d):
    """Prescriptions converted to table texts, one for each lens."""
    stanzas, glasses = _lenses(spark, d)
    tables = [(prescriptions.surfaces(stanzas, "p_partkey", glasses), *_COLUMNS[0]), (prescriptions.aspheric(stanzas, "p_partkey", 2), *_COLUMNS[1])]
    first, second = (stores.table_cells(df, F.lit(t), F.lit(p), ["i"], cs, keys=("p_partkey",)) for df, t, p, _, cs in tables)
    return stores.joined_tables(stores.text_of_tables(first.unionByName(second), keys=("p_partkey",)), ["p_partkey"])


@query("SELECT 'G' || r_regionkey AS name, ('1.5' || r_regionkey)::DOUBLE AS nd, ('6' || r_regionkey)::DOUBLE AS vd FROM region WHERE r_regionkey < 3")
def glasses_of_stanzas(spark, d):
    return _lenses(spark, d)[1]


_LINES3 = """WITH l AS (SELECT label, embedding[1]::DOUBLE AS p0, embedding[2]::DOUBLE AS p1, embedding[3]::DOUBLE AS p2, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings),
    u AS (SELECT label, p0, p1, p2, a / sqrt(a * a + b * b + c * c) AS u0, b / sqrt(a * a + b * b + c * c) AS u1, c / sqrt(a * a + b * b + c * c) AS u2 FROM l),
    s AS (SELECT label, sum(1 - u0 * u0) AS a00, sum(-u0 * u1) AS a01, sum(-u0 * u2) AS a02, sum(1 - u1 * u1) AS a11, sum(-u1 * u2) AS a12, sum(1 - u2 * u2) AS a22,
        sum(p0 - u0 * (u0 * p0 + u1 * p1 + u2 * p2)) AS b0, sum(p1 - u1 * (u0 * p0 + u1 * p1 + u2 * p2)) AS b1, sum(p2 - u2 * (u0 * p0 + u1 * p1 + u2 * p2)) AS b2 FROM u GROUP BY label),
    q AS (SELECT *, a01 / a00 AS f, a02 / a00 AS g FROM s), r AS (SELECT *, a11 - f * a01 AS c11, a12 - f * a02 AS c12, a22 - g * a02 AS c22, b1 - f * b0 AS d1, b2 - g * b0 AS d2 FROM q),
    t AS (SELECT *, (d2 - c12 / c11 * d1) / (c22 - c12 / c11 * c12) AS z FROM r), v AS (SELECT *, (d1 - c12 * z) / c11 AS y FROM t)
    SELECT label, round((b0 - a01 * y - a02 * z) / a00, 7) AS x, round(y, 7) AS y, round(z, 7) AS z FROM v"""


@query(_LINES3)
def nearest_to_lines(spark, d):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    n = F.sqrt(e(3) * e(3) + e(4) * e(4) + e(5) * e(5))
    lines = T(spark, d, "embeddings").select("label", *[e(k).alias(f"p{k}") for k in range(3)], *[(e(3 + k) / n).alias(f"u{k}") for k in range(3)])
    out = stats.line_intersection(lines, ["label"], ["p0", "p1", "p2"], ["u0", "u1", "u2"])
    return out.select("label", *[F.round(c, 7).alias(c) for c in "xyz"])


@query("""WITH p AS (SELECT vec_id, list_sort(list_transform(embedding[1:5], lambda x: x::DOUBLE)) AS p, embedding[6]::DOUBLE / 2 AS c FROM embeddings),
    m AS (SELECT vec_id, p, c, (p[2] + p[3] + p[4]) / 3 AS inner_, k, 0.4::DOUBLE / 2 ** k AS m FROM p, range(50) t(k)),
    w AS (SELECT *, ((1 - m) * p[5] - (c - m * inner_)) / (p[5] - p[1]) AS p0 FROM m), f AS (SELECT * FROM w WHERE p0 > 0 AND 1 - m - p0 > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY k) = 1)
    SELECT p.vec_id, i, round(CASE i WHEN 0 THEN f.p0 WHEN 4 THEN 1 - f.m - f.p0 ELSE f.m / 3 END, 8) AS weight FROM p LEFT JOIN f ON p.vec_id = f.vec_id, range(5) t(i)""")
def mixture_of_points(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", F.array_sort(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))).alias("p"), (F.get("embedding", F.lit(5)).cast("double") / 2).alias("c"))
    w = e.select("vec_id", sequences.mixture_weights(F.col("p"), F.col("c")).alias("w"))
    return w.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).select("vec_id", "i", F.round(F.get("w", F.col("i").cast("int")), 8).alias("weight"))


_BLURS = """WITH c AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, abs(embedding[i]::DOUBLE) AS colour, least(abs(embedding[65 - i]::DOUBLE) * 2, 1) AS alpha FROM embeddings, range(1, 65) t(i)),
    k AS (SELECT u, v, (1 + u + 2 * v) / 36.0::DOUBLE AS w FROM range(3) a(u), range(3) b(v)),
    b AS (SELECT o.vec_id, o.y, o.x, sum(w * c.colour * c.alpha) AS ca, sum(w * c.alpha) AS a FROM c o, k JOIN c ON c.vec_id = o.vec_id AND c.y = o.y + 1 - u AND c.x = o.x + 1 - v GROUP BY o.vec_id, o.y, o.x)
    SELECT n.vec_id // 2 AS picture, n.y, n.x, round(n.ca + coalesce(f.ca, 0) * (1 - least(greatest(n.a, 0), 1)), 8) AS value FROM b n LEFT JOIN b f ON f.vec_id = n.vec_id + 1 AND f.y = n.y AND f.x = n.x WHERE n.vec_id % 2 = 0"""


@query(_BLURS)
def blurred_layers(spark, d):
    """Pairs of layers, the odd one behind, blurred with one kernel."""
    k = [(1.0 + u + 2 * v) / 36 for u in range(3) for v in range(3)]
    e = T(spark, d, "embeddings").select(F.expr("vec_id div 2").alias("picture"), (F.col("vec_id") % 2).alias("depth"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("colour"), F.transform(F.reverse("embedding"), lambda x: F.least(F.abs(x.cast("double")) * 2, F.lit(1.0))).alias("alpha"), F.array(*map(F.lit, k)).alias("kernel"))
    out = tensors.layered_blur(e, ["picture"], "depth", "colour", "alpha", "kernel", 8, 8, 3)
    return out.select("picture", F.posexplode("image").alias("p", "v")).select("picture", F.expr("(p div 8)").cast("long").alias("y"), (F.col("p") % 8).cast("long").alias("x"), F.round("v", 8).alias("value"))


_RAYS = """WITH r AS (SELECT vec_id, embedding[1]::DOUBLE AS ox, embedding[2]::DOUBLE AS oy, -3.0::DOUBLE AS oz, embedding[3]::DOUBLE / 2 AS dx, embedding[4]::DOUBLE / 2 AS dy, (vec_id % 7 - 3) * 0.6::DOUBLE AS c FROM embeddings),
    n AS (SELECT *, sqrt(dx * dx + dy * dy + 1) AS l FROM r), d AS (SELECT vec_id, ox, oy, oz, c, dx / l AS dx, dy / l AS dy, 1 / l AS dz FROM n),
    q AS (SELECT *, c * (ox * dx + oy * dy + oz * dz) - dz AS b, c * (ox * ox + oy * oy + oz * oz) - 2 * oz AS f FROM d), e AS (SELECT *, b * b - c * f AS disc FROM q),
    t AS (SELECT *, CASE WHEN c = 0 THEN -f / (2 * b) ELSE (-b - sqrt(greatest(disc, 0))) / c END AS t1, CASE WHEN c = 0 THEN -f / (2 * b) ELSE (-b + sqrt(greatest(disc, 0))) / c END AS t2 FROM e),
    h AS (SELECT *, CASE WHEN abs(oz + t1 * dz) <= abs(oz + t2 * dz) THEN t1 ELSE t2 END AS t FROM t), p AS (SELECT *, ox + t * dx AS px, oy + t * dy AS py, oz + t * dz AS pz FROM h),
    m AS (SELECT *, c * px AS nx, c * py AS ny, c * pz - 1 AS nz FROM p), s AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS nl, CASE WHEN nx * dx + ny * dy + nz * dz > 0 THEN -1 ELSE 1 END AS g FROM m),
    u AS (SELECT *, g * nx / nl AS ux, g * ny / nl AS uy, g * nz / nl AS uz FROM s), k AS (SELECT *, -(ux * dx + uy * dy + uz * dz) AS ci FROM u),
    v AS (SELECT *, 1 - (1 - ci * ci) / 2.25 AS rest FROM k), w AS (SELECT *, ci / 1.5 - sqrt(greatest(rest, 0)) AS a FROM v)"""


@query(_RAYS + " SELECT vec_id, disc >= 0 AS hit, CASE WHEN disc >= 0 THEN round(t, 7) END AS t, CASE WHEN disc >= 0 THEN round(dx / 1.5 + a * ux, 7) + 0.0 END AS x, CASE WHEN disc >= 0 THEN round(dy / 1.5 + a * uy, 7) + 0.0 END AS y, CASE WHEN disc >= 0 THEN round(dz / 1.5 + a * uz, 7) + 0.0 END AS z FROM w")
def refracted_rays(spark, d):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    rays = T(spark, d, "embeddings").select("vec_id", F.array(e(0), e(1), F.lit(-3.0)).alias("o"), C.unit(F.array(e(2) / 2, e(3) / 2, F.lit(1.0))).alias("d"), ((F.col("vec_id") % 7 - 3) * 0.6).alias("c"))
    h = rays.withColumn("h", C.sphere_hit(F.col("o"), F.col("d"), "c"))
    r = h.withColumn("r", C.refracted(F.col("d"), F.col("h.normal"), F.lit(1 / 1.5)))
    shown = lambda c: F.when(F.col("h.defined"), F.round(c, 7) + 0.0)
    return r.select("vec_id", F.col("h.defined").alias("hit"), shown(F.col("h.t")).alias("t"), *[shown(F.col("r.direction")[k]).alias(n) for k, n in enumerate("xyz")])


@query("""WITH m AS (SELECT n, m FROM range(60) a(n), range(60) b(m) WHERE m <= n AND (n - m) % 2 = 0), s AS (SELECT n, m, sum(CASE WHEN m = 0 THEN 1 ELSE 2 END) OVER (ORDER BY n, m) AS upto, CASE WHEN m = 0 THEN 1 ELSE 2 END AS size FROM m),
    j AS (SELECT n, CASE WHEN m = 0 THEN 0 WHEN (upto - size + 1 + k) % 2 = 0 THEN m ELSE -m END AS m, upto - size + 1 + k AS j FROM s, range(2) t(k) WHERE k < size)
    SELECT p_partkey, n, m::BIGINT AS m, round(CASE WHEN m = 0 THEN sqrt(n + 1) ELSE sqrt(2 * (n + 1)) END, 9) AS norm FROM part JOIN j ON j.j = p_partkey % 500 + 1""")
def zernike_modes(spark, d):
    z = C.zernike_mode(F.col("p_partkey") % 500 + 1)
    return T(spark, d, "part").select("p_partkey", z["n"].alias("n"), z["m"].alias("m"), F.round(z["norm"], 9).alias("norm"))
