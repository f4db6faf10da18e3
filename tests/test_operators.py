"""Golden cases of the operators' edge rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import columns as C
from loomwork.operators import arrays, joins, lookup, rank, sequences, stats, stores, tensors
from loomwork.sources import files
from loomwork.streaming import ledger


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


@pytest.mark.parametrize(
    "args, want",
    [
        ((5, 2, 4, 6), ("Mobile", "Wide (Main)")),
        ((4, 2, 4, 6), ("Mobile", "Ultra-Wide")),
        ((5, 2, 4, 15), ("Mobile", "Wide (Main)")),
        ((10, 2, 6, 16), ("Unknown", "N/A")),
        ((20, 2, 9, 30), ("Unknown", "N/A")),
        ((50, 1.8, 21.6, 70), ("System Camera", "Standard/Normal")),
        ((24, 2.8, 21.6, 90), ("System Camera", "Retrofocus Wide")),
        ((24, 2.8, 21.6, 28), ("System Camera", "Wide")),
        ((200, 4, 21.6, 150), ("System Camera", "Compact Telephoto")),
        ((200, 4, 21.6, 210), ("System Camera", "Telephoto")),
        ((50, 9, 21.6, 70), ("Unknown", "N/A")),
    ],
)
def test_classify(spark, args, want):
    assert tuple(one(spark, C.classify_lens(*args))[0]) == want


def test_seeds(spark):
    r = one(spark, C.tag_seed(F.lit(0), F.lit("crop")), C.tag_seed(F.lit(0), F.lit("dpdd")), C.tag_seed(F.lit(7), F.lit("blur")))
    assert tuple(r) == (1979298382, 2883975515, 2644966810)


def test_guarded(spark):
    r = one(spark, C.safe_div(F.lit(6), F.lit(3)), C.safe_div(F.lit(5), F.lit(0)), C.safe_div(F.lit(0), F.lit(0)), C.safe_sqrt(F.lit(-4)), C.safe_mul(F.lit(0.0), F.lit(float("inf"))))
    assert tuple(r[0]) == (2, True) and tuple(r[1]) == (5, False) and tuple(r[2]) == (0, False) and tuple(r[3]) == (1, False) and r[4] == 0


def test_blur_radius(spark):
    r = one(spark, *[C.signed_blur_radius(F.lit(z), F.lit(-1.0), F.lit(20.0), F.lit(-0.01), F.lit(0.01)) for z in (-2.0, -1.0, -0.5)])
    assert r[0] == pytest.approx(0.00022021581149526403) and r[1] == 0 and r[2] == pytest.approx(-0.00044603033006244426)


def test_cells(spark):
    d = spark.createDataFrame([("-",), ("INF",), ("12",), ("-3",), ("1.5e-3",), ("X",)], "t string")
    assert [r[0] for r in d.select(C.coerce_cell("t")["kind"]).collect()] == ["null", "inf", "int", "int", "double", "string"]
    d = spark.createDataFrame([(0.0,), (1e-5,), (2e6,), (1.25,), (float("inf"),), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in d.select(C.format_cell("v")).collect()] == ["0", "1.00000E-05", "2.00000E+06", "1.25", "INF", "-", "-"]


def test_scene_key(spark):
    d = spark.createDataFrame([("MPI_alley_1_frame_0001_f_9.4_fp_1",), ("SYNTHIA_Omni_F_000012",), ("OTHER_x_f_1",)], "t string")
    assert [r[0] for r in d.select(C.scene_key("t")).collect()] == ["MPI_alley_1_frame_0001", "SYNTHIA_Omni_F_000012", None]


def test_lookup_rules(spark):
    d = spark.createDataFrame([(95, True, None), (91, False, "x"), (10, True, "y")], "score int, active boolean, note string")
    assert lookup.find(d, score__gt=90, active=True).count() == 1
    assert lookup.find(d, note=None).count() == 0
    assert lookup.find(d, note__ne="x").count() == 1
    with pytest.raises(ValueError):
        lookup.find(d, score__like=1)
    with pytest.raises(KeyError):
        lookup.find(d, nothing=1)


def test_selectors(spark):
    d = spark.createDataFrame([(c,) for c in "edcba"], "name string")
    names = lambda *s: [r[0] for r in lookup.select_names(d, "name", list(s)).collect()]
    assert names("-1") == ["e"] and names("3:") == ["d", "e"] and names("1", "0:2") == ["b", "a"]
    with pytest.raises(KeyError):
        names("9")


def test_set_rules(spark):
    a, b = (spark.createDataFrame([(c,) for c in s], "value string") for s in ("abc", "bcd"))
    text = lambda df: "".join(sorted(r[0] for r in df.collect()))
    assert [text(x) for x in (stores.union(a, b), stores.intersection(a, b), stores.difference(a, b), stores.symmetric_difference(a, b))] == ["abcd", "bc", "a", "ad"]
    assert not stores.is_subset(a, b).first()[0] and not stores.is_disjoint(a, b).first()[0]
    with pytest.raises(Exception, match="no such value"):
        stores.remove(a, b).collect()


def test_store_rules(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert stores.delete(d, "v", "a").count() == 1
    with pytest.raises(ValueError):
        stores.update(d, "k", 1, {})
    with pytest.raises(Exception, match="duplicate key"):
        stores.insert(d, spark.createDataFrame([(2, "z")], "k int, v string"), "k").collect()
    assert stores.insert(d, spark.createDataFrame([(3, "z")], "k int, v string"), "k").count() == 3


def test_ready(spark):
    s = lambda *v: spark.createDataFrame([(x,) for x in v], "item int")
    assert [r[0] for r in joins.ready_items([s(1, 2, 3, 4), s(2, 3, 4)], [s(2), s(3)]).collect()] == [4]


def test_table_diff(spark):
    a = spark.createDataFrame([("k1", 1.0), ("k2", 2.0), ("k3", None)], "k string, v double")
    b = spark.createDataFrame([("k2", 2.005), ("k3", None), ("k4", 4.0)], "k string, v double")
    diff = lambda t: sorted((r.k, r.status) for r in joins.table_diff(a, b, "k", t).collect())
    assert diff(0.01) == [("k1", "only_a"), ("k4", "only_b")]
    assert diff(0.0) == [("k1", "only_a"), ("k2", "changed"), ("k4", "only_b")]


def test_pairs(spark):
    a, b = (spark.createDataFrame([(c,) for c in s], "name string") for s in ("ab", "ac"))
    with pytest.raises(Exception, match="no partner"):
        joins.pair_by_name(a, b, "name").collect()
    p = joins.pair_by_order(a, b.withColumnRenamed("name", "other"), ["name"], ["other"]).collect()
    assert sorted((r.name, r.other) for r in p) == [("a", "a"), ("b", "c")]
    with pytest.raises(ValueError):
        joins.pair_by_order(a, b.limit(1), ["name"], ["name"])


@pytest.mark.parametrize("scores, want", [((18, 9), (0, True)), ((18, 16), (0, False)), ((14, 9), (0, False))])
def test_disambiguation(spark, scores, want):
    d = spark.createDataFrame([(1, k, float(s)) for k, s in enumerate(scores)], "g int, k int, s double")
    r = joins.argmax_candidate(d, ["g"], "s", "k", 15).first()
    assert (r.pick, r.confident) == want


def test_minmax_ties(spark):
    d = spark.createDataFrame([("a", 1, 10, 2), ("b", 3, 20, 4), ("c", 2, 30, 4), ("d", 3, 20, 4)], "id string, x int, y int, z int")
    s = rank.minmax_product(d, ["x", "y", "z"])
    assert {r.id: r.score for r in s.collect()} == {"a": 0, "b": 0.5, "c": 0.5, "d": 0.5}
    assert sorted(r.id for r in rank.top_k(s, "score", ["id"], 2).collect()) == ["c", "d"]
    s = rank.minmax_product(d.withColumn("w", F.lit(1)), ["x", "y", "z", "w"])
    assert sorted(r.id for r in rank.top_k(s, "score", ["id"], 2).collect()) == ["c", "d"]


def test_numbered_over_ranges(spark):
    d = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"))
    got = rank.numbered(d, ["v"], parts=16, few=100).collect()
    assert all(r.rn == r.v + 1 for r in got) and len(got) == 5000


def test_numbered_with_nulls_and_nan(spark):
    rows = [(None, None), *[(None, k) for k in range(40)], *[(float(k % 7), k) for k in range(100)], *[(float("nan"), k) for k in range(30)]]
    got = rank.numbered(spark.createDataFrame(rows, "x double, k int").repartition(5), ["x", "k"], parts=16, few=10).collect()
    place = lambda r: (r.x is not None, r.x is not None and r.x != r.x, r.x if r.x is not None and r.x == r.x else 0.0, r.k is not None, r.k or 0)
    assert [r.rn for r in sorted(got, key=place)] == list(range(1, len(rows) + 1))


def test_greedy_cluster(spark):
    d = spark.createDataFrame([(1, v) for v in (0.0, 0.9, 2.0, 2.1)], "g int, v double")
    got = {r.v: r.centre for r in sequences.greedy_cluster(d, ["g"], "v", 1.0).collect()}
    assert got == {0.0: 1.0, 0.9: 1.0, 2.0: 2.1, 2.1: 2.1}


def test_greedy_cluster_within_eps(spark):
    values = np.round(np.random.default_rng(0).uniform(0, 50, 400), 3)
    d = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    assert all(abs(r.v - r.centre) <= 1.0 + 1e-9 for r in sequences.greedy_cluster(d, ["g"], "v", 1.0).collect())


def test_greedy_cluster_of_dense_groups(spark):
    """Groups without gaps, over several batches, against the plain loop; also the fold over one array."""
    rng = np.random.default_rng(1)
    values = {g: np.unique(np.round(rng.uniform(0, 300, 9_000), 2)) for g in (1, 2, None)}
    d = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g int, v double").repartition(7)
    got = {(r.g, r.v): r.centre for r in sequences.greedy_cluster(d, ["g"], "v", 1.0).collect()}
    for g, vs in values.items():
        clusters = []
        for v in vs.tolist():
            if clusters and v - clusters[-1][0] <= 2.0:
                clusters[-1][1] = v
            else:
                clusters.append([v, v])
        centres = np.array([(a + b) / 2 for a, b in clusters])
        for v in vs.tolist():
            assert got[g, v] == centres[np.argmin(np.abs(centres - v))]
        if g == 1:
            folded = spark.createDataFrame([(vs.tolist(),)], "a array<double>").select(sequences.greedy_centres(F.col("a"), 1.0).alias("c")).first().c
            assert folded == centres.tolist()


def test_local_scales(spark):
    d = spark.createDataFrame([(1, v) for v in (1.0, 1.5, 4.0, 4.25)], "g int, v double")
    assert [r.scale for r in sequences.local_scales(d, ["g"], "v").orderBy("v").collect()] == [0.5, 0.5, 0.25, 0.25]


def test_mixture_weights(spark):
    r = one(spark, sequences.mixture_weights(F.array(*[F.lit(v) for v in (0.0, 1.0, 2.0, 10.0)]), F.lit(4.0)))[0]
    assert sum(r) == pytest.approx(1) and sum(w * v for w, v in zip(r, (0, 1, 2, 10), strict=True)) == pytest.approx(4) and min(r) > 0


def test_finite_summary(spark):
    d = spark.createDataFrame([(v, float("nan")) for v in (30.0, 32.0, 34.0, float("nan"), float("inf"))], "m double, n double")
    s = {r.metric: r for r in stats.summary(d, ["m", "n"]).collect()}
    assert (s["m"].mean, s["m"].count) == (32, 3) or (s["m"]["mean"], s["m"]["count"]) == (32, 3)
    assert s["m"]["std"] == pytest.approx(1.632993161855452)
    assert math.isnan(s["n"]["mean"]) and s["n"]["count"] == 0
    assert [r.metric for r in stats.parsed_means(d, ["m", "n"]).collect()] == ["m"]


def test_psnr(spark):
    a, b = (F.array(*[F.lit(v) for v in x]) for x in ((0.0, 0.0, 0.5, 1.0), (0.0, 0.1, 0.5, 0.8)))
    mse = stats.mean_squared_error(a, b)
    r = one(spark, mse, stats.psnr(mse), stats.psnr(F.lit(0.0)))
    assert r[0] == pytest.approx(0.0125) and r[1] == pytest.approx(19.0309, abs=1e-4) and r[2] == float("inf")


def test_line_intersection(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 2.0, -1.0, 3.0, 0.0, 1.0, 0.0), (1, 2.0, 0.0, -5.0, 0.0, 0.0, 1.0)], "g int, x double, y double, z double, a double, b double, c double")
    r = stats.line_intersection(d, ["g"], ["x", "y", "z"], ["a", "b", "c"]).first()
    assert r.x == pytest.approx(2) and r.y == pytest.approx(0)


def test_chunks(spark):
    x = F.array(*[F.lit(k) for k in range(7)])
    r = one(spark, arrays.chunk(x, 3), arrays.unchunk(arrays.chunk(x, 3), 7))
    assert r[0] == [[0, 1, 2], [3, 4, 5], [6, 6, 6]] and r[1] == list(range(7))


def test_tensors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random(64), rng.random(64)
    d = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    kernel = rng.random((3, 3))
    r = d.select(tensors.convolved("a", kernel, 8, 8).alias("c"), tensors.ssim("a", "a", 8, 8).alias("s"), tensors.gradient_score("a", 8, 8).alias("g"), tensors.shifted("a", 8, 8, 1.0, 0.0).alias("h")).first()
    want = np.zeros((8, 8))
    padded = np.pad(a.reshape(8, 8), 1)
    for i in range(8):
        for j in range(8):
            want[i, j] = (padded[i : i + 3, j : j + 3] * kernel[::-1, ::-1]).sum()
    assert np.allclose(np.array(r.c).reshape(8, 8), want) and r.s == pytest.approx(1)
    sx = np.outer([1, 2, 1], [1, 0, -1])
    p = np.pad(a.reshape(8, 8), 1, mode="reflect")
    g = sum(math.hypot((p[i : i + 3, j : j + 3] * sx).sum(), (p[i : i + 3, j : j + 3] * sx.T).sum()) for i in range(8) for j in range(8))
    assert r.g == pytest.approx(g)
    assert np.allclose(np.array(r.h).reshape(8, 8)[1:], a.reshape(8, 8)[:-1])


def test_least_squares(spark):
    d = spark.createDataFrame([(1, 1.0, float(x), 3.0 + 2 * x) for x in range(9)], "g int, one double, x double, y double")
    assert tensors.masked_least_squares(d, ["g"], ["one", "x"], "y").first().coefficients == pytest.approx([3, 2])


def test_text_tables(spark):
    text = "SURFACES\n  i  R  STOP\n  ------------\n  1  10.5  X\n  2  -\n# note\nNEXT\n  a\n  INF  extra\n"
    d = files.text_tables(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text")
    got = {(r.table, r.row, r.column): (r.cell, r.kind) for r in d.collect()}
    assert got[("SURFACES", 1, "R")] == ("10.5", "double") and got[("SURFACES", 2, "STOP")] == (None, "null") and got[("NEXT", 1, "a")] == ("INF", "inf") and len(got) == 7


def test_stanzas(spark):
    text = 'SURF 0\n  TYPE STANDARD\n  GLAS "BK 7" 1\nSURF 1\n  DISZ 4'
    d = files.stanza_lines(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text")
    got = {r.line: (r.parent, r.keyword, r.params) for r in d.collect()}
    assert got == {0: (None, "SURF", ["0"]), 1: (0, "TYPE", ["STANDARD"]), 2: (0, "GLAS", ["BK 7", "1"]), 3: (None, "SURF", ["1"]), 4: (3, "DISZ", ["4"])}


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,TRUE\n2,no\n")
    assert [tuple(r) for r in files.table_csv(spark, str(tmp_path / "t.csv"), {"a": int, "b": bool}).collect()] == [(1, True), (2, False)]
    (tmp_path / "kv.csv").write_text("key,value\nx,1\ny,2\nx,3\n")
    assert dict(files.key_value_csv(spark, str(tmp_path / "kv.csv")).collect()) == {"x": "3", "y": "2"}
    (tmp_path / "jobs.txt").write_text("model,weight,dataset\n# no\n m , w , d \nshort,row\n\n")
    assert [tuple(r) for r in files.job_rows(spark.read.text(str(tmp_path / "jobs.txt"))).collect()] == [("m", "w", "d")]
    names = [r.name for r in files.with_extensions(files.listing(spark, str(tmp_path)), [".csv"]).orderBy("name").collect()]
    assert names == ["kv.csv", "t.csv"]


def test_ledger(spark):
    d = spark.createDataFrame([("s", "1", "failed", "boom", 1), ("s", "1", "done", None, 2), ("s", "2", "failed", "bad", 3), ("u", "1", "done", None, 1), ("u", "2", "done", None, 1)], ledger.SCHEMA)
    assert {r.item: (r.status, r.error) for r in ledger.latest(d.where("stage = 's'")).collect()} == {"1": ("done", None), "2": ("failed", "bad")}
    assert [r.item for r in ledger.ready(d, ["u"], "s").collect()] == ["2"]
    assert ledger.is_complete(d.unionByName(ledger.skip_all_failed(d, "s", 9)), ["u"], "s").first()[0]


def test_incremental_run(spark, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    for k in (1, 2):
        spark.range(10 * k).write.mode("append").parquet(src)
        ledger.run_once(spark, src, "id long", lambda df: df.selectExpr("id * 2 AS v"), sink, check).awaitTermination()
        assert spark.read.parquet(sink).count() == (10 if k == 1 else 30)


def test_streamed_windows(spark, tmp_path):
    d = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id) AS ts, 'a' AS event_type, 1.0D AS value FROM range(120)")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = ledger.event_windows(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows_").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("windows_").collect()) == 120


def test_prescription(spark):
    from loomwork.sources import prescriptions

    text = "UNIT MM X\nSURF 0\n  TYPE STANDARD\n  DISZ INFINITY\nSURF 1\n  STOP\n  TYPE EVENASPH\n  CURV 0.02 0 0\n  DISZ 4.5\n  GLAS BK7 0 0\n  DIAM 8 1\n  CONI -1\n  PARM 2 1e-5\n  PARM 4 2e-9\nSURF 2\n  GLAS ___BLANK 1 0 1.6 50\n"
    s = files.stanza_lines(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text")
    glass = spark.createDataFrame([("BK7", 1.5168, 64.17)], "name string, nd double, vd double")
    rows = {r.i: r for r in prescriptions.surfaces(s, "doc", glass).collect()}
    assert (rows[0].SHAPE, rows[0].D, rows[0].R) == ("FLAT", float("inf"), None)
    assert (rows[1].STOP, rows[1].SHAPE, rows[1].R, rows[1].Nd, rows[1].APERSEMI) == ("X", "ASPH", 50.0, 1.5168, 8.0)
    assert (rows[2].Nd, rows[2].Vd) == (1.6, 50.0)
    a = prescriptions.aspheric(s, "doc").collect()
    assert len(a) == 1 and (a[0].i, a[0].K, a[0].A4, a[0].A6, a[0].A8) == (1, -1.0, 1e-5, 0.0, 2e-9)
    with pytest.raises(Exception, match="unknown glass: BK7"):
        prescriptions.surfaces(s, "doc", glass.limit(0)).collect()


def test_size_text_keeps_long_documents(spark, tmp_path):
    from loomwork.plans import catalogue

    spark.createDataFrame([(1, 10), (2, 400_000), (3, 2_000_000)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r["size"] for r in catalogue.QUERIES["size_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "201.0 B", 2: "298.0 GB", 3: "7.3 TB"}


def test_layered_blur(spark):
    """Two layers against a plain convolution."""
    rng = np.random.default_rng(3)
    layers = [(1, z, rng.random(20).tolist(), rng.random(20).tolist(), (k / k.sum()).ravel().tolist()) for z, k in ((2.0, rng.random((3, 3))), (5.0, rng.random((3, 3))))]
    d = spark.createDataFrame(layers, "img int, z double, c array<double>, a array<double>, k array<double>")
    got = np.array(tensors.layered_blur(d, ["img"], "z", "c", "a", "k", 4, 5, 3).first().image).reshape(4, 5)

    def blur(x, k):
        out = np.zeros((4, 5))
        for y in range(4):
            for j in range(5):
                out[y, j] = sum(k[1 + dy, 1 + dx] * x[y - dy, j - dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= y - dy < 4 and 0 <= j - dx < 5)
        return out

    want = np.zeros((4, 5))
    for _, _, c, a, k in sorted(layers, key=lambda r: -r[1]):
        c, a, k = np.reshape(c, (4, 5)), np.reshape(a, (4, 5)), np.reshape(k, (3, 3))
        want = blur(c * a, k) + want * (1 - np.clip(blur(a, k), 0, 1))
    assert np.allclose(got, want)
