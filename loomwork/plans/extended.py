"""Queries for stores, generators, resumable sources, group work, scans, gathers, transforms and pairings, each with its SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.functions import columns as C
from loomwork.functions import sampling
from loomwork.operators import arrays, groups, images, joins, lookup, scans, stats, stores, tensors
from loomwork.plans.catalogue import T, _u, query
from loomwork.plans.families import _PIXELS, _RGB, _pixels, _rgb
from loomwork.sources import files
from loomwork.sources import tensors as store
from loomwork.sources.shared import shared_folder
from loomwork.streaming import ledger, units

# tensor store -----------------------------------------------------------------------------------------


def _stored_tensors(spark, d):
    e = T(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = files.tensor_rows(e.withColumn("key", F.lpad(F.col("vec_id").cast("string"), 9, "0")), "key", "embedding", [8, 8], "float32")
    path = shared_folder(spark, "tensors")
    store.write_tensors(rows, path)
    return path


@query("""WITH t AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS key, embedding FROM embeddings),
    r AS (SELECT 'key' AS way, * FROM t WHERE key = '000000042' UNION ALL SELECT 'keys', * FROM t WHERE key IN ('000000007', '000000301', 'none')
          UNION ALL SELECT 'prefix', * FROM t WHERE key LIKE '0000001%' UNION ALL SELECT 'range', * FROM t WHERE key >= '000000095' AND key < '000000205')
    SELECT way, key, 'float32' AS dtype, 64::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM r""")
def tensors_by_key(spark, d):
    path = _stored_tensors(spark, d)
    ways = {"key": {"keys": ["000000042"]}, "keys": {"keys": ["000000007", "000000301", "none"]}, "prefix": {"prefix": "0000001"}, "range": {"low": "000000095", "high": "000000204"}}
    n, total = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x), F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    out = [store.read_tensors(spark, path, **asked).select(F.lit(w).alias("way"), "key", "dtype", n.alias("n"), F.round(total, 6).alias("total")) for w, asked in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT lpad(vec_id::VARCHAR, 9, '0') AS key, 'float32' AS dtype, '8x8' AS shape FROM embeddings")
def tensor_headers(spark, d):
    t = store.read_tensors(spark, _stored_tensors(spark, d), data=False)
    return t.select("key", "dtype", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"))


@query("""SELECT lpad(vec_id::VARCHAR, 9, '0') AS key, CASE WHEN label = 3 THEN 'float64' ELSE 'float32' END AS dtype,
    round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * CASE WHEN label = 3 THEN 2 ELSE 1 END)), 6) AS total FROM embeddings""")
def tensors_put(spark, d):
    path = _stored_tensors(spark, d)
    e = T(spark, d, "embeddings").where("label = 3").withColumn("key", F.lpad(F.col("vec_id").cast("string"), 9, "0"))
    times = lambda k: files.tensor_rows(e.withColumn("x", F.transform("embedding", lambda v: v.cast("double") * k)), "key", "x", [64]).withColumn("at", F.lit(k))
    store.put_tensors(times(5).unionByName(times(2).withColumn("at", F.lit(9))), path, "at")
    t = store.read_tensors(spark, path)
    return t.select("key", "dtype", F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# units ------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE u AS (SELECT s_suppkey, cycle FROM supplier, range(3) t(cycle) WHERE cycle < 1 + s_nationkey % 3),
    r AS (SELECT s_suppkey, cycle, 0 AS k, (s_suppkey * 1009 + cycle * 9176 + 12345) % 2147483648 AS x, NULL::DOUBLE AS last, 0 AS n, false AS hit FROM u
        UNION ALL SELECT s_suppkey, cycle, k + 1, y, CASE WHEN ok THEN v ELSE last END, n + ok::INT, ok FROM (
            SELECT *, y / 2147483648.0::DOUBLE * 100 AS v, last IS NULL OR abs(y / 2147483648.0::DOUBLE * 100 - last) >= 30 AS ok
            FROM (SELECT *, (1103515245 * x + 12345) % 2147483648 AS y FROM r WHERE k < 9 AND n < 4)))
    SELECT s_suppkey, cycle, printf('c%03d__u%d__draw__%04d', cycle, s_suppkey, n - 1) AS item, k AS draw, round(last, 9) AS value FROM r WHERE hit""")
def generated_units(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", (1 + F.col("s_nationkey") % 3).alias("cycles"))
    u = ledger.cycles(s, "cycles").withColumns({"gap": F.lit(30.0), "most": F.lit(4), "tries": F.lit(9)})
    out = units.unit_items(u, ["s_suppkey", "cycle", "gap", "most", "tries"], units.spaced_draws, "item string, draw int, value double")
    return out.select("s_suppkey", "cycle", "item", "draw", F.round("value", 9).alias("value"))


def _moody(unit, cycle):
    """Draws of a unit, which fails in each fourth cycle."""
    if (unit + cycle) % 4 == 0:
        raise ValueError(f"not in cycle {cycle}")
    yield from units.spaced_draws(unit, cycle, 30.0, 4, 9)


_WORK = """WITH RECURSIVE r AS (SELECT s_suppkey, cycle, 0 AS k, (s_suppkey * 1009 + cycle * 9176 + 12345) % 2147483648 AS x, NULL::DOUBLE AS last, 0 AS n, false AS hit FROM supplier, range(4) t(cycle) WHERE (s_suppkey + cycle) % 4 > 0
        UNION ALL SELECT s_suppkey, cycle, k + 1, y, CASE WHEN ok THEN v ELSE last END, n + ok::INT, ok FROM (
            SELECT *, y / 2147483648.0::DOUBLE * 100 AS v, last IS NULL OR abs(y / 2147483648.0::DOUBLE * 100 - last) >= 30 AS ok
            FROM (SELECT *, (1103515245 * x + 12345) % 2147483648 AS y FROM r WHERE k < 9 AND n < 4))),
    o AS (SELECT *, row_number() OVER (ORDER BY cycle, s_suppkey, n) AS rn FROM r WHERE hit), t AS (SELECT 6 * count(*) AS t FROM supplier)"""


@query(_WORK + " SELECT s_suppkey, cycle::INTEGER AS cycle, n - 1 AS k, printf('c%03d__u%d__draw__%04d', cycle, s_suppkey, n - 1) AS item, round(last, 9) AS value FROM o, t WHERE rn <= t")
def produced_items(spark, d):
    s = T(spark, d, "supplier")
    items, _ = units.produce_until(s, "s_suppkey", ["s_suppkey"], _moody, "item string, draw int, value double", 6 * s.count())
    return items.select("s_suppkey", "cycle", "k", "item", F.round("value", 9).alias("value"))


@query(_WORK + " SELECT s_suppkey, cycle::INTEGER AS cycle, 'ValueError: not in cycle ' || cycle AS error FROM supplier, range(4) u(cycle), t WHERE (s_suppkey + cycle) % 4 = 0 AND cycle <= (SELECT max(cycle) FROM o WHERE rn <= t.t)")
def failed_units(spark, d):
    s = T(spark, d, "supplier")
    return units.produce_until(s, "s_suppkey", ["s_suppkey"], _moody, "item string, draw int, value double", 6 * s.count())[1]


@query("""WITH w AS (SELECT n_name AS source, cycle, s_suppkey AS unit, s_suppkey % 7 AS produced, coalesce(sum(s_suppkey % 7) OVER (PARTITION BY n_name ORDER BY cycle, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM supplier JOIN nation ON s_nationkey = n_nationkey, range(3) t(cycle))
    SELECT source, cycle::INTEGER AS cycle, unit, least(produced, 25 - before)::BIGINT AS taken, least(before + produced, 25)::BIGINT AS accepted FROM w WHERE before < 25""")
def resumed_sources(spark, d):
    """Cycle 0 in a first run, which ends; cycles 1 and 2 in a second one, from the checkpoint."""
    folder, sink, checkpoint = (shared_folder(spark, x) for x in ("units", "units-taken", "units-checkpoint"))
    s = T(spark, d, "supplier").join(T(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    for cycles in ((0,), (1, 2)):
        for c in cycles:
            rows = s.select(F.col("n_name").alias("source"), F.lit(c).alias("cycle"), F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 7).alias("produced"))
            rows.repartition(1).write.mode("append").parquet(folder)
        units.run_until_target(spark, folder, sink, checkpoint, 25).awaitTermination()
    return spark.read.schema("source string, cycle int, unit long, taken long, accepted long").parquet(sink).drop("batch")


# groups -----------------------------------------------------------------------------------------------


def _totals(key, batches):
    """Running totals of a customer's orders; small orders are skipped, and a dear pending order is an error for each third customer."""
    total = 0.0
    for batch in batches:
        item, price = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("item", "o_totalprice"))
        bad = np.flatnonzero((batch.column("o_orderstatus").to_numpy(zero_copy_only=False) == "P") & (price >= 100_000) & (key[0] % 3 == 0))
        n = int(bad[0]) if len(bad) else len(item)
        small = price[:n] < 50_000
        sums = total + np.cumsum(np.where(small, 0.0, price[:n]))
        total = sums[-1] if n else total
        yield pa.record_batch([pa.array(item[:n]), pa.array(np.where(small, "skipped", "done")), pa.array(sums, mask=small)], names=["item", "status", "total"])
        if n < len(item):
            raise ValueError(f"order {item[n]}")


_ITEMS = """SELECT *, CASE WHEN broken THEN 'failed' WHEN o_totalprice < 50000 THEN 'skipped' ELSE 'done' END AS status FROM (
    SELECT *, o_orderkey AS item, max((o_orderstatus = 'P' AND o_totalprice >= 100000 AND o_custkey % 3 = 0)::INT) OVER w = 1 AS broken, sum(CASE WHEN o_totalprice < 50000 THEN 0 ELSE o_totalprice END) OVER w AS total
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


def _worked(spark, d):
    orders = T(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("item"), F.col("o_totalprice").cast("double"), "o_orderstatus")
    return groups.process_groups(orders, ["o_custkey"], ["item"], "item", _totals, "total double")


@query(f"SELECT o_custkey, item, status, status = 'failed' AS has_error, CASE WHEN status = 'done' THEN round(total, 4)::DOUBLE END AS total FROM ({_ITEMS})")
def group_items(spark, d):
    return _worked(spark, d).select("o_custkey", "item", "status", F.col("error").isNotNull().alias("has_error"), F.round("total", 4).alias("total"))


@query(f"""WITH i AS ({_ITEMS}) SELECT CASE WHEN o_custkey % 3 = 0 THEN 'thirds' ELSE 'others' END AS stage, sum((status = 'done')::INT)::BIGINT AS done,
    sum((status = 'skipped')::INT)::BIGINT AS skipped, sum((status = 'failed')::INT)::BIGINT AS failed FROM i GROUP BY 1""")
def group_ledger(spark, d):
    stage = F.when(F.col("o_custkey") % 3 == 0, "thirds").otherwise("others")
    log = _worked(spark, d).select(stage.alias("stage"), F.col("item").cast("string").alias("item"), "status", "error", F.lit(1).cast("long").alias("at"))
    return ledger.counts(log)


@query("SELECT c_nationkey, c_custkey, round(max(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 2) AS best, sum((c_acctbal < 0)::INT) OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::BIGINT AS debts FROM customer")
def folded_balances(spark, d):
    def step(state, row):
        best, debts = state or (row["c_acctbal"], 0)
        state = max(best, row["c_acctbal"]), debts + (row["c_acctbal"] < 0)
        return state, {"c_custkey": row["c_custkey"], "best": round(state[0], 2), "debts": state[1]}

    c = T(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("double"))
    return groups.ordered_fold(c, ["c_nationkey"], "c_custkey", step, "c_nationkey int, c_custkey long, best double, debts long")


# scans ------------------------------------------------------------------------------------------------

_STEPS = "SELECT p_brand, p_partkey, (p_size % 5) * 0.0917::DOUBLE AS t, -(p_partkey % 3) * 0.0473::DOUBLE AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part"


@query(f"""WITH RECURSIVE s AS ({_STEPS}), r AS (SELECT p_brand, p_partkey, rn, 1 + t * c AS a, t AS b, c AS c, 1.0::DOUBLE AS d FROM s WHERE rn = 1
    UNION ALL SELECT s.p_brand, s.p_partkey, s.rn, (1 + t * s.c) * r.a + t * r.c, (1 + t * s.c) * r.b + t * r.d, s.c * r.a + r.c, s.c * r.b + r.d FROM r JOIN s ON s.p_brand = r.p_brand AND s.rn = r.rn + 1)
    SELECT p_brand, p_partkey, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c, round(d, 9) AS d FROM r""")
def prefix_matrices(spark, d):
    t, c = (F.col("p_size") % 5) * 0.0917, -(F.col("p_partkey") % 3) * 0.0473
    steps = T(spark, d, "part").select("p_brand", "p_partkey", (1 + t * c).alias("a"), t.alias("b"), c.alias("c"), F.lit(1.0).alias("d"))
    out = scans.prefix_scan(steps, ["p_brand"], ["p_partkey"], ["a", "b", "c", "d"], scans.matrix_combine, parts=16, few=256)
    return out.select("p_brand", "p_partkey", *[F.round(x, 9).alias(x) for x in "abcd"])


@query("SELECT o_orderpriority, o_orderkey, round(sum(o_totalprice) OVER w, 2)::DOUBLE AS total, (count(*) OVER w)::DOUBLE AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)")
def prefix_sums(spark, d):
    orders = T(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.col("o_totalprice").cast("double").alias("total"), F.lit(1.0).alias("n"))
    out = scans.prefix_scan(orders, ["o_orderpriority"], ["o_orderkey"], ["total", "n"], scans.sum_combine, parts=16, few=1024)
    return out.withColumn("total", F.round("total", 2))


# images -----------------------------------------------------------------------------------------------


def _affine_sql(y: str, x: str, fill: str) -> str:
    return f"""WITH p AS ({_PIXELS}), c AS (SELECT vec_id, i, j, 2.5 + vec_id % 3 + 0.8::DOUBLE * (i - 1.5) + 0.3::DOUBLE * (j - 2) AS sy, 3.25::DOUBLE - 0.2::DOUBLE * (i - 1.5) + 1.1::DOUBLE * (j - 2) AS sx FROM embeddings, range(4) a(i), range(5) b(j)),
    q AS (SELECT vec_id, i, j, floor(sy)::BIGINT + dy AS y, floor(sx)::BIGINT + dx AS x, CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END * CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END AS w FROM c, range(2) u(dy), range(2) v(dx))
    SELECT q.vec_id, i, j, round(sum(w * coalesce(v, {fill})), 8) AS value FROM q LEFT JOIN p ON p.vec_id = q.vec_id AND p.y = {y} AND p.x = {x} GROUP BY q.vec_id, i, j"""


def _affine(spark, d, border):
    e = T(spark, d, "embeddings").select("vec_id", (2.5 + F.col("vec_id") % 3).alias("cy"), F.lit(3.25).alias("cx"), *[F.lit(v).alias(n) for n, v in zip("abcd", (0.8, 0.3, -0.2, 1.1), strict=True)])
    at = images.patch_coordinates(e, 4, 5, ("cy", "cx"), ("a", "b", "c", "d"))
    out = images.gathered(at, _pixels(spark, d), ["vec_id"], 8, 8, ["vec_id"], border, 0.5)
    return out.select("vec_id", F.col("i").cast("long"), F.col("j").cast("long"), F.round("value", 8).alias("value"))


@query(_affine_sql("q.y", "q.x", "0.5"))
def affine_patches(spark, d):
    return _affine(spark, d, "constant")


@query(_affine_sql("greatest(0, least(7, q.y))", "greatest(0, least(7, q.x))", "0"))
def affine_patches_nearest(spark, d):
    return _affine(spark, d, "nearest")


@query(_affine_sql("least(((q.y % 14) + 14) % 14, 14 - ((q.y % 14) + 14) % 14)", "least(((q.x % 14) + 14) % 14, 14 - ((q.x % 14) + 14) % 14)", "0"))
def affine_patches_mirror(spark, d):
    return _affine(spark, d, "mirror")


@query(f"""WITH p AS ({_PIXELS}), g AS (SELECT picture, max(k) // 5 + 1 AS n FROM (SELECT vec_id // 12 AS picture, vec_id % 12 AS k FROM embeddings) GROUP BY 1),
    o AS (SELECT picture, y, x, (y // 9) * 5 + x // 9 AS k, y % 9 - 1 AS iy, x % 9 - 1 AS ix FROM g, range(28) a(y), range(46) b(x) WHERE y < n * 9 + 1)
    SELECT picture, o.y, o.x, coalesce(p.v, -1) AS value FROM o LEFT JOIN p ON p.vec_id // 12 = picture AND p.vec_id % 12 = k AND p.y = iy AND p.x = ix""")
def montages(spark, d):
    tiles = _pixels(spark, d).select(F.expr("vec_id div 12").alias("picture"), (F.col("vec_id") % 12).alias("k"), "y", "x", "value")
    return images.montage(tiles, ["picture"], 8, 8, 5, 1, -1.0)


@query(f"""WITH p AS ({_PIXELS}) SELECT e.vec_id, a.y, b.x, p.v AS value, a.y < 8 AND b.x < 8 AS own FROM embeddings e, range(10) a(y), range(10) b(x)
    JOIN p ON p.vec_id = e.vec_id AND p.y = CASE WHEN a.y < 8 THEN a.y ELSE 14 - a.y END AND p.x = CASE WHEN b.x < 8 THEN b.x ELSE 14 - b.x END""")
def padded_images(spark, d):
    return images.padded_to_multiple(_pixels(spark, d), ["vec_id"], 5)


_ERODED = f"""SELECT vec_id, y, x, min(v) OVER w AS low, count(*) OVER w AS n, {_u("'9'", 'vec_id', 'y', 'x')} AS u FROM (SELECT vec_id, y, x, min((v > -0.2)::INT) OVER r AS v, count(*) OVER r AS n FROM ({_PIXELS})
    WINDOW r AS (PARTITION BY vec_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE n = 3 WINDOW w AS (PARTITION BY vec_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""


@query(f"SELECT vec_id, y, x FROM ({_ERODED}) WHERE n = 3 AND low = 1")
def eroded_mask(spark, d):
    mask = _pixels(spark, d).withColumn("ok", F.col("value") > -0.2)
    return images.eroded(mask, ["vec_id"], "ok", 1, 1).where("eroded").select("vec_id", F.col("y").cast("long"), F.col("x").cast("long"))


@query(f"""WITH c AS (SELECT vec_id, arg_max({{'y': y, 'x': x}}, u) AS p FROM ({_ERODED}) WHERE n = 3 AND low = 1 GROUP BY vec_id)
    SELECT e.vec_id, p.y AS y, p.x AS x, p IS NOT NULL AS found FROM embeddings e LEFT JOIN c ON c.vec_id = e.vec_id""")
def eroded_picks(spark, d):
    mask = _pixels(spark, d).withColumn("ok", F.col("value") > -0.2)
    return images.eroded_pick(mask, ["vec_id"], "ok", 1, 1, F.lit(9)).select("vec_id", F.col("y").cast("long"), F.col("x").cast("long"), "found")


_TURBO = {"r": (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943), "g": (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604), "b": (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973)}


@query(f"""WITH p AS (SELECT vec_id, y, x, 1 / (abs(v) * (1 + vec_id % 40) + 0.0137::DOUBLE) AS i FROM ({_PIXELS})), e AS (SELECT vec_id, greatest(min(i), 1 / 250.0::DOUBLE) AS lo, least(max(i), 10) AS hi FROM p GROUP BY 1),
    l AS (SELECT p.vec_id, y, x, greatest(0, least(1, (i - lo) / (hi - lo))) AS t FROM p JOIN e ON e.vec_id = p.vec_id)
    SELECT vec_id, y, x, """ + ", ".join(f"floor(greatest(0, least(1, {' + '.join(f'({c}::DOUBLE * t ** {k})' for k, c in enumerate(cs))})) * 255)::INTEGER AS {n}" for n, cs in _TURBO.items()) + " FROM l")
def depth_pictures(spark, d):
    c = _pixels(spark, d).withColumn("depth", F.abs("value") * (1 + F.col("vec_id") % 40) + 0.0137)
    return arrays.depth_colours(c, ["vec_id"], "depth").select("vec_id", F.col("y").cast("long"), F.col("x").cast("long"), "r", "g", "b")


def _toss(name):
    return _u("'8'", "vec_id", f"'{name}'") + " < 0.5"


@query(f"""WITH f AS (SELECT vec_id, {_toss('hflip')} AS h, {_toss('vflip')} AS v, {_toss('turn')} AS t FROM embeddings), p AS (SELECT q.vec_id, t, value, CASE WHEN f.v THEN 7 - y ELSE y END AS y, CASE WHEN h THEN 7 - x ELSE x END AS x FROM
    (SELECT vec_id, y, x, v AS value FROM ({_PIXELS})) q JOIN f ON f.vec_id = q.vec_id) SELECT vec_id, CASE WHEN t THEN x ELSE y END AS y, CASE WHEN t THEN y ELSE x END AS x, value FROM p""")
def augmented_images(spark, d):
    a = sampling.augmentation(F.lit(8), "vec_id")
    p = _pixels(spark, d).withColumn("p", images.augmented(F.col("y"), F.col("x"), 8, 8, a["hflip"], a["vflip"], a["turn"]))
    return p.select("vec_id", F.col("p.y").cast("long").alias("y"), F.col("p.x").cast("long").alias("x"), "value")


@query(f"""SELECT vec_id, CASE vec_id % 9 WHEN 2 THEN y WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x WHEN 8 THEN 7 - x ELSE y END AS y,
    CASE vec_id % 9 WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y WHEN 8 THEN y ELSE x END AS x, v AS value FROM ({_PIXELS})""")
def oriented_images(spark, d):
    p = _pixels(spark, d).withColumn("p", images.oriented(F.col("y"), F.col("x"), 8, 8, F.col("vec_id") % 9))
    return p.select("vec_id", F.col("p.y").cast("long").alias("y"), F.col("p.x").cast("long").alias("x"), "value")


@query(f"""SELECT vec_id, k, round(65.481 * r + 128.553 * g + 24.966 * b + 16, 6) AS y, round(-37.797 * r - 74.203 * g + 112.0 * b + 128, 6) AS cb, round(112.0 * r - 93.786 * g - 18.214 * b + 128, 6) AS cr,
    round(r, 8) AS first, round(g, 8) AS second, round(2 * b - r / 2 - g / 2, 8) AS third FROM ({_RGB})""")
def colour_channels(spark, d):
    c = C.ycbcr("r", "g", "b")
    back = arrays.inverse_combination([F.col(x) for x in "rgb"], [[2.0, 0.0, 0.0], [0.0, 4.0, 0.0], [1.0, 1.0, 2.0]], True)
    return _rgb(spark, d).select("vec_id", "k", *[F.round(c[n], 6).alias(n) for n in ("y", "cb", "cr")], *[F.round(v, 8).alias(n) for n, v in zip(("first", "second", "third"), back, strict=True)])


@query("""SELECT l_returnflag, 'mean' AS way, round(sum(abs(l_discount - l_tax) * l_quantity) / (3 * sum(l_quantity)), 8) AS loss FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'sum', round(sum(abs(l_discount - l_tax) * l_quantity), 4) FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'plain', round(avg(abs(l_discount - l_tax)), 8) FROM lineitem GROUP BY 1""")
def reduced_losses(spark, d):
    x = T(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.abs(F.col("l_discount") - F.col("l_tax")).alias("loss"))
    ways = {"mean": (8, "mean", "l_quantity", 3), "sum": (4, "sum", "l_quantity", 1), "plain": (8, "mean", None, 1)}
    out = [stats.reduced_loss(x, ["l_returnflag"], "loss", how, weight, channels).select("l_returnflag", F.lit(w).alias("way"), F.round("loss", digits).alias("loss")) for w, (digits, how, weight, channels) in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH p AS (SELECT vec_id, k, list_sort(list_transform(embedding[1:5], lambda x: x::DOUBLE)) AS p, {_u("'11'", 'vec_id', 'k', "'choice'")} * 15 AS u, sqrt(-2 * ln(1 - {_u("'11'", 'vec_id', 'k', "'noise'", "'radius'")})) * cos(2 * pi() * {_u("'11'", 'vec_id', 'k', "'noise'", "'angle'")}) AS z FROM embeddings, range(4) t(k)),
    c AS (SELECT *, CASE WHEN u < 1 THEN 1 WHEN u < 3 THEN 2 WHEN u < 6 THEN 3 WHEN u < 10 THEN 4 ELSE 5 END AS i FROM p)
    SELECT vec_id, k::INTEGER AS k, round(least(greatest(p[i] + 0.5 * z * CASE i WHEN 1 THEN p[2] - p[1] WHEN 5 THEN p[5] - p[4] ELSE least(p[i] - p[i - 1], p[i + 1] - p[i]) END, -0.2), 0.2), 8) AS sample FROM c""")
def noisy_samples(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", F.array_sort(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))).alias("p"))
    w = F.array(*[F.lit(float(k)) for k in (1, 2, 3, 4, 5)])
    return sampling.noisy_samples(e, "p", w, -0.2, 0.2, 0.5, 4, F.lit(11), "vec_id").select("vec_id", "k", F.round("sample", 8).alias("sample"))


@query("SELECT p_partkey, p_brand AS shape_brand, p_size AS shape_size, p_retailprice AS price_amount, p_size > 25 AS large FROM part")
def nested_rows(spark, d):
    n = lookup.nested(T(spark, d, "part").drop("p_name", "p_type"), {"shape": {"brand": "p_brand", "size": "p_size"}, "price": {"amount": "p_retailprice"}})
    return lookup.flattened(n.where("shape.size > 0").withColumn("large", F.col("shape.size") > 25))


# transforms -------------------------------------------------------------------------------------------


def _parts(spectrum: str, *keep: str):
    z = F.posexplode(F.arrays_zip(f"{spectrum}.re", f"{spectrum}.im")).alias("k", "z")
    return lambda df: df.select(*keep, z).select(*keep, "k", F.round(F.col("z.re") + 0.0, 7).alias("re"), F.round(F.col("z.im") + 0.0, 7).alias("im"))


@query(f"""WITH p AS ({_PIXELS}) SELECT vec_id, (u * 8 + w)::INTEGER AS k, round(sum(v * cos(2 * pi() * ((u - 4) * (y - 4) + (w - 4) * (x - 4)) / 8.0)), 7) + 0.0 AS re,
    round(-sum(v * sin(2 * pi() * ((u - 4) * (y - 4) + (w - 4) * (x - 4)) / 8.0)), 7) + 0.0 AS im FROM p, range(8) a(u), range(8) b(w) GROUP BY vec_id, u, w""")
def centred_spectra(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    return e.select("vec_id", tensors.centred_dft("a", (8, 8)).alias("s")).transform(_parts("s", "vec_id"))


@query("""WITH p AS (SELECT vec_id, i - 1 AS n, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), f AS (SELECT k, -0.5 + (k + 0.5) * 1.75 / 20 AS f FROM range(20) t(k))
    SELECT vec_id, k::INTEGER AS k, round(sum(v * cos(2 * pi() * f * 0.4 * (n - 31.5))), 7) + 0.0 AS re, round(-sum(v * sin(2 * pi() * f * 0.4 * (n - 31.5))), 7) + 0.0 AS im FROM p, f GROUP BY vec_id, k""")
def zoomed_spectra(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    return e.select("vec_id", tensors.zoomed_dft("a", 64, 0.4, -0.5, 1.25, 20).alias("s")).transform(_parts("s", "vec_id"))


# dependencies and pairs -------------------------------------------------------------------------------

_EDGES = """SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS needs FROM orders
    UNION SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) FROM orders"""


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE needs IS NOT NULL), r AS (SELECT o_orderkey AS node, 0 AS level FROM orders WHERE o_orderkey NOT IN (SELECT node FROM e)
    UNION SELECT e.node, level + 1 FROM r JOIN e ON e.needs = r.node) SELECT node, max(level) AS level FROM r GROUP BY node""")
def order_levels(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    edges = [o.selectExpr("o_orderkey AS node", f"lag(o_orderkey) OVER (PARTITION BY o_custkey, {c} ORDER BY o_orderkey) AS needs") for c in ("o_orderpriority", "o_orderstatus")]
    return joins.dependency_levels(o.select(F.col("o_orderkey").alias("node")), edges[0].unionByName(edges[1]), "node", "needs")


_LOW = "SELECT 'input/' || replace(p_brand, '#', '') || '/' || p_partkey || '.jpg' AS low, replace(p_brand, '#', '') AS key FROM part"
_HIGH = "SELECT DISTINCT 'ground_truth/' || replace(p_brand, '#', '') || '.png' AS high, replace(p_brand, '#', '') AS key FROM part WHERE p_brand NOT LIKE '%3' UNION SELECT 'ground_truth/S' || s_suppkey || '.png', 'S' || s_suppkey FROM supplier"
_PAIRS = f"SELECT coalesce(a.key, b.key) AS key, low, high, CASE WHEN high IS NULL THEN 'no_high' WHEN low IS NULL THEN 'no_low' ELSE 'paired' END AS status FROM ({_LOW}) a FULL JOIN ({_HIGH}) b ON a.key = b.key"


def _folder_pairs(spark, d):
    brand = F.regexp_replace("p_brand", "#", "")
    p = T(spark, d, "part")
    low = p.select(F.concat(F.lit("input/"), brand, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"))
    high = p.where(~F.col("p_brand").endswith("3")).select(F.concat(F.lit("ground_truth/"), brand, F.lit(".png")).alias("path")).distinct()
    high = high.unionByName(T(spark, d, "supplier").select(F.concat(F.lit("ground_truth/S"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("path")))
    return joins.derived_pairs(low, high, "path", joins.folder_key("path"), joins.stem_key("path"))


@query(_PAIRS)
def folder_pairs(spark, d):
    return _folder_pairs(spark, d)


@query(f"""WITH p AS ({_PAIRS}) SELECT sum((status = 'paired')::INT)::BIGINT AS paired, count(DISTINCT CASE WHEN status = 'paired' THEN low END) AS low_paired, count(DISTINCT CASE WHEN status = 'paired' THEN high END) AS high_paired,
    sum((status = 'no_high')::INT)::BIGINT AS low_alone, sum((status = 'no_low')::INT)::BIGINT AS high_alone, sum((status <> 'paired')::INT) = 0 AS complete FROM p""")
def folder_pair_report(spark, d):
    return joins.pair_completeness(_folder_pairs(spark, d))


@query("""WITH l AS (SELECT 'image/' || p_type || '/image' || lpad(p_partkey::VARCHAR, 6, '0') || '.png' AS low, 'sharp' || lpad(p_partkey::VARCHAR, 6, '0') AS key FROM part),
    h AS (SELECT 'GT/sharp' || lpad(p_partkey::VARCHAR, 6, '0') || kind AS high, 'sharp' || lpad(p_partkey::VARCHAR, 6, '0') AS key FROM part, (VALUES ('.png'), ('.tif')) t(kind) WHERE p_size % 9 > 0 OR kind = '.tif' AND p_size = 9)
    SELECT coalesce(l.key, h.key) AS key, low, high, CASE WHEN high IS NULL THEN 'no_high' ELSE 'paired' END AS status FROM l FULL JOIN h ON l.key = h.key""")
def renamed_file_pairs(spark, d):
    p = T(spark, d, "part").withColumn("n", F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    low = p.select(F.concat(F.lit("image/"), F.col("p_type"), F.lit("/image"), F.col("n"), F.lit(".png")).alias("path"))
    high = p.withColumn("kind", F.explode(F.array(F.lit(".png"), F.lit(".tif")))).where("p_size % 9 > 0 OR kind = '.tif' AND p_size = 9")
    return joins.derived_pairs(low, high.select(F.concat(F.lit("GT/sharp"), F.col("n"), F.col("kind")).alias("path")), "path", joins.stem_key("path", 5, "sharp"), joins.stem_key("path"))


_TABLES = """WITH c AS (SELECT r_name, r_regionkey, n_nationkey, n_name AS name, n_nationkey::VARCHAR AS k, CASE WHEN n_nationkey = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.5f', n_nationkey / 7.0::DOUBLE), '0+$', ''), '\\.$', '') END AS share FROM nation JOIN region ON n_regionkey = r_regionkey),
    w AS (SELECT r_name, greatest(max(length(name)), 6)::INT AS a, greatest(max(length(k)), 11)::INT AS b, greatest(max(length(share)), 5)::INT AS s FROM c GROUP BY 1),
    t AS (SELECT c.r_name, r_regionkey, c.r_name || chr(10) || '  ' || rpad('n_name', a, ' ') || '  ' || rpad('n_nationkey', b, ' ') || '  ' || rpad('share', s, ' ') || chr(10) || '  ' || repeat('-', a + b + s + 14) || chr(10)
        || string_agg('  ' || rpad(name, a, ' ') || '  ' || lpad(k, b, ' ') || '  ' || lpad(share, s, ' '), chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM c JOIN w ON c.r_name = w.r_name GROUP BY c.r_name, r_regionkey, a, b, s)"""


@query(_TABLES + " SELECT r_regionkey % 2 AS half, string_agg(text, chr(10) ORDER BY r_regionkey) AS text FROM t GROUP BY 1")
def table_texts(spark, d):
    n = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("share", F.col("n_nationkey") / 7.0)
    cells = stores.table_cells(n, F.col("r_name"), F.col("r_regionkey"), ["n_nationkey"], ["n_name", "n_nationkey", "share"])
    texts = stores.text_of_tables(cells).withColumn("half", F.col("place") % 2)
    return stores.joined_tables(texts, ["half"])
