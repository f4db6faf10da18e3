"""Stores, generators, resumable sources, group work, scans, gathers, transforms, levels and pairings against plain versions."""

import collections
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.functions import columns as C
from loomwork.functions import sampling
from loomwork.operators import arrays, groups, images, joins, lookup, scans, stats, stores, tensors
from loomwork.sources import files
from loomwork.sources import tensors as store
from loomwork.streaming import ledger, units

# tensor store


def tensor_frame(spark, rows):
    return spark.createDataFrame(rows, "key string, dtype string, shape array<bigint>, data array<double>")


def test_tensor_round_trip(spark, tmp_path):
    rows = [(f"k{n:03d}", ("int16", "float32", "float64", "uint8")[n % 4], [n % 5, 2], [float(x % 200) for x in range(n % 5 * 2)]) for n in range(60)] + [("ключ", "float64", [], [0.1])]
    path = f"file://{tmp_path}/t"
    store.write_tensors(tensor_frame(spark, rows), path, 6)
    got = {r.key: (r.dtype, r.shape, r.data) for r in store.read_tensors(spark, path).collect()}
    assert got == {k: (t, s, d) for k, t, s, d in rows}
    assert got["ключ"] == ("float64", [], [0.1])
    heads = store.read_tensors(spark, path, data=False).collect()
    assert all(r.data is None for r in heads) and {(r.key, tuple(r.shape)) for r in heads} == {(k, tuple(s)) for k, _, s, _ in rows}


def test_tensor_ranges_are_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_tensors(tensor_frame(spark, [(f"{n:04d}", "float64", [1], [float(n)]) for n in range(400)]), path, 8)
    read = lambda **k: store.read_tensors(spark, path, **k)
    assert read().rdd.getNumPartitions() == 8
    one, some, none = read(keys=["0123"]), read(prefix="00", high="0049"), read(keys=[])
    assert one.rdd.getNumPartitions() == 1 and [r.key for r in one.collect()] == ["0123"]
    assert some.rdd.getNumPartitions() <= 2 and some.count() == 50
    assert none.collect() == [] and read(low="0390").count() == 10 and read(keys=["0001", "0002"], prefix="0002").count() == 1
    both = one.unionByName(read(keys=["0001", "x"])).unionByName(read().where("key = '0007'"))  # reads of one plan don't mix
    assert sorted(r.key for r in both.collect()) == ["0001", "0007", "0123"]


def test_tensor_writes_are_atomic(spark, tmp_path):
    path = str(tmp_path / "t")
    good = tensor_frame(spark, [(f"{n}", "float64", [1], [float(n)]) for n in range(9)])
    store.write_tensors(good, path, 3)
    for bad in ([("a", "float64", [2], [1.0])], [(None, "float64", [1], [1.0])], [("a", "no type", [1], [1.0])]):
        with pytest.raises(Exception, match="(?s)numbers for the shape|no key|no type|not understood"):
            store.write_tensors(tensor_frame(spark, bad), path)
        assert store.read_tensors(spark, path).count() == 9
    store.write_tensors(tensor_frame(spark, [("x", "int8", [1], [5.0])]), path, append=True)
    assert store.read_tensors(spark, path).count() == 10
    new = tensor_frame(spark, [("3", "float64", [1], [30.0]), ("3", "float64", [1], [31.0]), ("y", "float64", [1], [0.0])]).withColumn("at", F.col("data")[0])
    store.put_tensors(new, path, "at", 2)
    store.vacuum(path)
    got = {r.key: r.data[0] for r in store.read_tensors(spark, path).collect()}
    assert got == {**{f"{n}": float(n) for n in range(9)}, "3": 31.0, "x": 5.0, "y": 0.0}
    store.write_tensors(good.limit(0), path)
    assert store.read_tensors(spark, path).collect() == []


def test_images(spark, tmp_path):
    """A bitmap of two by two pixels, and a file that is none."""
    rows = bytes([1, 2, 3, 4, 5, 6, 0, 0]) + bytes([7, 8, 9, 10, 11, 12, 0, 0])  # from the bottom, blue first
    head = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(rows), 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + rows)
    (tmp_path / "b.bmp").write_bytes(b"no picture")
    (r,) = files.images(spark, str(tmp_path)).collect()
    assert (r.height, r.width, r.channels, bytes(r.data)) == (2, 2, 3, bytes([7, 8, 9, 10, 11, 12, 1, 2, 3, 4, 5, 6])) and r.path.endswith("a.bmp")


# units


def countdown(name, n):
    if name == "bad":
        raise ValueError("no such unit")
    seen = []
    for k in range(n or 0):
        seen.append(k)
        yield k, sum(seen)


@pytest.mark.parametrize("arrow", [True, False])
def test_unit_items(spark, arrow):
    u = spark.createDataFrame([("a", 3), ("b", 0), ("c", 1), (None, 2), ("d", None)], "name string, n int")
    got = sorted((tuple(r) for r in units.unit_items(u, ["name", "n"], countdown, "k int, total long", arrow).collect()), key=str)
    assert got == sorted([("a", 3, 0, 0), ("a", 3, 1, 1), ("a", 3, 2, 3), ("c", 1, 0, 0), (None, 2, 0, 0), (None, 2, 1, 1)], key=str)
    with pytest.raises(Exception, match="no such unit"):
        units.unit_items(u.limit(1).withColumn("name", F.lit("bad")), ["name", "n"], countdown, "k int, total long", arrow).collect()


def test_source_goes_on_where_it_stopped(spark, tmp_path):
    """Stopped after two of four files, and given one file again: the result is that of one uninterrupted run."""
    rnd = random.Random(1)
    rows = [(s, c, u, rnd.randrange(6)) for s in ("a", "b", "c") for c in range(4) for u in range(5)]
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def add(cycle):
        part = [r for r in rows if r[1] == cycle]
        spark.createDataFrame(rnd.sample(part, len(part)), "source string, cycle int, unit long, produced long").coalesce(1).write.mode("append").parquet(folder)

    target = 30
    for cycles in ((0, 1), (), (1, 2, 3)):
        for c in cycles:
            add(c)
        units.run_until_target(spark, folder, sink, checkpoint, target).awaitTermination()
    got = spark.read.parquet(sink).drop("batch")
    assert got.groupBy("source", "cycle", "unit").count().where("count > 1").isEmpty()
    for s in ("a", "b", "c"):
        u = spark.createDataFrame([(c * 5 + k, n) for t, c, k, n in rows if t == s], "place long, n long")
        want = {(r.place // 5, r.place % 5): r.taken for r in ledger.until_target(u, ["place"], "n", 1, target).collect()}
        assert {(r.cycle, r.unit): r.taken for r in got.where(F.col("source") == s).collect()} == want
    assert got.groupBy("source").agg(F.sum("taken").alias("t")).where(F.col("t") > target).isEmpty()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != units.ROCKSDB


def flaky(unit, most, cycle):
    if unit == 3 and cycle != 1 or unit == 9:
        raise KeyError(unit)
    for k in range((unit + cycle) % most):
        yield (f"{unit}-{cycle}-{k}",)


def test_produce_until(spark):
    u = spark.createDataFrame([(n, 4) for n in range(1, 8)], "unit int, most int").repartition(3)
    order = [(n, c, k, f"{n}-{c}-{k}") for c in range(9) for n in range(1, 8) if n != 3 or c == 1 for k in range((n + c) % 4)]
    for target in (1, 10, 11, 25):
        items, failures = units.produce_until(u, "unit", ["unit", "most"], flaky, "name string", target)
        got = sorted(((r.unit, r.cycle, r.k, r.name) for r in items.collect()), key=lambda r: (r[1], r[0], r[2]))
        assert got == order[:target]
        last = order[target - 1][1]
        assert sorted(tuple(r) for r in failures.collect()) == [(3, c, "KeyError: 3") for c in range(last + 1) if c != 1]
    with pytest.raises(RuntimeError, match="unit 9 failed 2 times in a row: KeyError: 9"):
        units.produce_until(u.unionByName(spark.createDataFrame([(9, 4)], u.schema)), "unit", ["unit", "most"], flaky, "name string", 1_000, most_failures=2)
    few, _ = units.produce_until(u, "unit", ["unit", "most"], flaky, "name string", 1_000, most_cycles=3)
    assert few.count() == len([r for r in order if r[1] < 3])


# groups


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def doubled(key, batches):
    for batch in batches:
        x = batch.column("x").to_pylist()
        if key[0] == "start":
            raise ValueError("nothing works")
        if 13 in x:
            k = x.index(13)
            yield pa.record_batch([batch.column("item").slice(0, k), pa.array([2.0 * v for v in x[:k]])], names=["item", "twice"])
            raise ValueError("unlucky")
        if key[0] == "early":
            return
        if key[0] == "quiet":
            continue
        yield pa.record_batch([batch.column("item"), pa.array(["skipped" if v % 2 else "done" for v in x]), pa.array([2.0 * v for v in x])], names=["item", "status", "twice"])


def test_groups_with_failures(small_batches):
    rows = [(g, f"{g}{n:02d}", n) for g in ("fine", "start", "breaks", "early", "quiet") for n in range(10)]
    rows = [(g, i, 13 if g == "breaks" and n == 4 else n) for g, i, n in rows]
    random.Random(2).shuffle(rows)
    d = small_batches.createDataFrame(rows, "g string, item string, x long")
    got = {r.item: r for r in groups.process_groups(d, ["g"], ["item"], "item", doubled, "twice double").collect()}
    assert len(got) == 50
    status = lambda g: [got[f"{g}{n:02d}"].status for n in range(10)]
    assert status("fine") == ["done", "skipped"] * 5 and status("start") == ["failed"] * 10 and status("breaks") == ["done", "skipped", "done"] + ["done"] + ["failed"] * 6
    assert status("early") == ["done"] * 10 == status("quiet") and got["fine03"].twice == 6.0 and got["early01"].twice is None
    assert "unlucky" in got["breaks05"].error and "nothing works" in got["start00"].error and got["breaks03"].error is None
    log = groups.process_groups(d, ["g"], ["item"], "item", doubled, "twice double").select(F.col("g").alias("stage"), "item", "status", "error", F.lit(1).cast("long").alias("at"))
    assert {r.stage: (r.done, r.skipped, r.failed) for r in ledger.counts(log).collect()}["breaks"] == (3, 1, 6)


def test_ordered_fold(small_batches):
    rows = [(g, n, (n * 7 + g) % 11) for g in (1, 2, None) for n in range(20) if g]
    random.Random(3).shuffle(rows)
    step = lambda s, r: (lambda t: (t, {"n": r["n"], "state": t}))((s or 0) * 3 % 1000 + r["x"])
    got = {(r.g, r.n): r.state for r in groups.ordered_fold(small_batches.createDataFrame(rows, "g int, n int, x int"), ["g"], "n", step, "g int, n int, state long").collect()}
    for g in (1, 2):
        s = None
        for n in range(20):
            s = (s or 0) * 3 % 1000 + (n * 7 + g) % 11
            assert got[g, n] == s


# scans


@pytest.mark.parametrize("few,parts", [(10, 7), (10, 64), (100_000, 7)])
def test_prefix_scan(small_batches, few, parts):
    rnd = random.Random(4)
    rows = [(g, n, *[rnd.uniform(-1, 1) for _ in "abcd"]) for g, size in (("big", 150), ("one", 1), ("mid", 30), ("two", 2)) for n in range(size)]
    d = small_batches.createDataFrame(rnd.sample(rows, len(rows)), "g string, n int, a double, b double, c double, d double")
    got = {(r.g, r.n): (r.a, r.b, r.c, r.d) for r in scans.prefix_scan(d, ["g"], ["n"], list("abcd"), scans.matrix_combine, parts, few).collect()}
    assert len(got) == len(rows)
    state = {}
    for g, n, *m in rows:
        m = np.array(m).reshape(2, 2)
        state[g] = m @ state[g] if g in state else m
        assert np.allclose(got[g, n], state[g].reshape(-1), rtol=1e-9, atol=1e-12)
    top = scans.prefix_scan(d.select("g", "n", "a"), ["g"], ["n"], ["a"], lambda x, y: [np.maximum(x[0], y[0])], parts, few)
    assert {(r.g, r.n): r.a for r in top.collect()}["big", 149] == max(r[2] for r in rows if r[0] == "big")
    assert scans.prefix_scan(d.limit(0), ["g"], ["n"], ["a"], scans.sum_combine).collect() == []


# images


def cells(spark, arrays):
    rows = [(k, y, x, float(a[y, x])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image int, y int, x int, value double")


def test_gather(spark):
    rng = np.random.default_rng(1)
    pictures = {k: rng.normal(size=(5, 6)) for k in range(2)}
    c = cells(spark, pictures)
    same = spark.createDataFrame([(0, 2.0, 2.5, 1.0, 0.0, 0.0, 1.0), (1, 2.0, 2.5, 1.0, 0.0, 0.0, 1.0)], "image int, cy double, cx double, a double, b double, c double, d double")
    at = images.patch_coordinates(same, 5, 6, ("cy", "cx"), ("a", "b", "c", "d"))
    for order in (0, 1):
        got = images.gathered(at, c, ["image"], 5, 6, ["image"], order=order).collect()
        assert len(got) == 60 and all(abs(r.value - pictures[r.image][r.i, r.j]) < 1e-12 for r in got)
    turned = spark.createDataFrame([(p, k, 1.3 * p, 4.1 - p, 0.7, -0.6, 0.5, 1.2) for p in range(3) for k in (0, 1)], "patch int, image int, cy double, cx double, a double, b double, c double, d double")
    at = images.patch_coordinates(turned, 3, 4, ("cy", "cx"), ("a", "b", "c", "d"))
    places = {(r.patch, r.image, r.i, r.j): (r.sy, r.sx) for r in at.collect()}
    rule = {"constant": None, "nearest": lambda v, n: min(max(v, 0), n - 1), "wrap": lambda v, n: v % n, "mirror": lambda v, n: (n - 1) - abs((v % (2 * n - 2)) - (n - 1))}
    for border, own in rule.items():
        got = {(r.patch, r.image, r.i, r.j): r.value for r in images.gathered(at, c, ["image"], 5, 6, ["patch", "image"], border, 9.0).collect()}
        for key, (sy, sx) in places.items():
            want = 0.0
            for y in (math.floor(sy), math.floor(sy) + 1):
                for x in (math.floor(sx), math.floor(sx) + 1):
                    w = (1 - abs(sy - y)) * (1 - abs(sx - x))
                    inside = 0 <= y < 5 and 0 <= x < 6
                    want += w * (pictures[key[1]][own(y, 5), own(x, 6)] if own else pictures[key[1]][y, x] if inside else 9.0)
            assert abs(got[key] - want) < 1e-9, (border, key)
    with pytest.raises(ValueError):
        images.gathered(at, c, ["image"], 5, 6, ["patch"], "sideways")


def test_montage_and_padding(spark):
    rng = np.random.default_rng(2)
    tiles = {k: rng.normal(size=(2, 3)) for k in (0, 1, 3)}  # the third tile is missing
    t = cells(spark, tiles).withColumnRenamed("image", "k").withColumn("g", F.lit(None).cast("string"))
    got = {(r.y, r.x): r.value for r in images.montage(t, ["g"], 2, 3, 2, 1, 7.0).collect()}
    want = np.full((7, 9), 7.0)
    for k, a in tiles.items():
        want[1 + k // 2 * 3 : 3 + k // 2 * 3, 1 + k % 2 * 4 : 4 + k % 2 * 4] = a
    assert got == {(y, x): want[y, x] for y in range(7) for x in range(9)}
    plain = {(r.y, r.x): r.value for r in images.montage(t, ["g"], 2, 3, 2).collect()}
    assert len(plain) == 24 and plain[2, 0] == 0.0 and plain[0, 3] == tiles[1][0, 0]
    a = rng.normal(size=(5, 7))
    padded = images.padded_to_multiple(cells(spark, {0: a}), ["image"], 4).collect()
    full = np.pad(a, ((0, 3), (0, 1)), mode="reflect")
    assert {(r.y, r.x): r.value for r in padded} == {(y, x): full[y, x] for y in range(8) for x in range(8)} and sum(r.own for r in padded) == 35
    with pytest.raises(Exception, match="too small"):
        images.padded_to_multiple(cells(spark, {0: a}), ["image"], 16).collect()


def test_padding_sends_no_cells_to_the_driver(spark):
    rng = np.random.default_rng(5)
    a = {k: rng.normal(size=(5 + k % 3, 6)) for k in range(9)}
    d = images.padded_to_multiple(cells(spark, a), ["image"], 5)
    got: dict = {}
    for r in d.collect():
        assert (r.y, r.x) not in got.setdefault(r.image, {})
        got[r.image][r.y, r.x] = r.value
    for k, m in a.items():
        full = np.pad(m, ((0, -m.shape[0] % 5), (0, 4)), mode="reflect")
        assert got[k] == {(y, x): v for (y, x), v in np.ndenumerate(full)}
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_orientation(spark):
    a = np.arange(12.0).reshape(3, 4)
    upright = {0: a, 1: a, 2: np.fliplr(a), 3: np.rot90(a, 2), 4: np.flipud(a), 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a, 1), 9: a}
    d = cells(spark, {0: a}).drop("image").withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("p", images.oriented(F.col("y"), F.col("x"), 3, 4, F.col("code")))
    got = {(r.code, r.p.y, r.p.x): r.value for r in d.collect()}
    assert got == {(k, y, x): m[y, x] for k, m in upright.items() for y in range(m.shape[0]) for x in range(m.shape[1])}
    flags = [(h, v, t) for h in (False, True) for v in (False, True) for t in (False, True)]
    f = cells(spark, {0: a}).crossJoin(spark.createDataFrame(flags, "h boolean, v boolean, t boolean"))
    for r in f.withColumn("p", images.augmented(F.col("y"), F.col("x"), 3, 4, F.col("h"), F.col("v"), F.col("t"))).collect():
        m = np.fliplr(a) if r.h else a
        m = np.flipud(m) if r.v else m
        assert (m.T if r.t else m)[r.p.y, r.p.x] == r.value


def test_channels_losses_and_nesting(spark):
    m = [[0.4, 0.3, 0.2], [0.1, 0.9, 0.1], [0.05, 0.1, 0.7]]
    d = spark.createDataFrame([(0.2, 0.5, 0.9), (1.0, 0.0, 0.3)], "r double, g double, b double")
    there = d.select(*[v.alias(n) for n, v in zip("rgb", arrays.linear_combination([F.col(c) for c in "rgb"], m, True), strict=True)])
    back = there.select(*arrays.inverse_combination([F.col(c) for c in "rgb"], m, True)).collect()
    assert np.allclose([list(r) for r in back], [list(r) for r in d.collect()])
    x = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 3.0), ("b", 5.0, 0.0)], "k string, loss double, w double")
    assert dict(map(tuple, stats.reduced_loss(x, ["k"], "loss", "mean", "w").collect())) == {"a": 3.5, "b": None}
    assert sorted(r.loss for r in stats.reduced_loss(x, ["k"], "loss", "none", "w").collect()) == [0.0, 2.0, 12.0]
    with pytest.raises(ValueError):
        stats.reduced_loss(x, ["k"], "loss", "median")
    n = lookup.nested(x, {"s": {"one": "loss", "two": "w"}})
    deep = n.withColumn("t", F.struct("s", F.lit(1).alias("n")))
    assert n.columns == ["k", "s"] and lookup.flattened(deep, ".").columns == ["k", "s.one", "s.two", "t.s.one", "t.s.two", "t.n"]
    with pytest.raises(ValueError, match="s_one"):
        lookup.flattened(n.withColumn("s_one", F.lit(0)))
    scales = spark.createDataFrame([([1.0, 4.0, 5.0],), ([3.0],), ([],)], "p array<double>").select(sampling.point_scales(F.col("p")).alias("s")).collect()
    assert [r.s for r in scales] == [[3.0, 1.0, 1.0], [None], []]


def test_erosion(spark):
    rng = np.random.default_rng(3)
    masks = {k: rng.random((7, 9)) < 0.9 for k in range(4)}
    masks[9] = np.zeros((7, 9), bool)
    d = cells(spark, masks).withColumn("ok", F.col("value") > 0)
    got = {(r.image, r.y, r.x) for r in images.eroded(d, ["image"], "ok", 1, 2).where("eroded").collect()}
    assert got == {(k, y, x) for k, m in masks.items() for y in range(1, 6) for x in range(2, 7) if m[y - 1 : y + 2, x - 2 : x + 3].all()}
    picks = {r.image: (r.y, r.x, r.found) for r in images.eroded_pick(d, ["image"], "ok", 1, 2, F.lit(1)).collect()}
    assert picks[9] == (None, None, False) and all((k, *picks[k][:2]) in got for k in masks if picks[k][2])
    many = d.where("image = 0").select(F.explode(F.sequence(F.lit(1), F.lit(600))).alias("image"), "y", "x", F.expr("y < 4 AND x < 6").alias("ok"))
    seen = collections.Counter((r.y, r.x) for r in images.eroded_pick(many, ["image"], "ok", 1, 2, F.lit(1)).collect())
    assert set(seen) == {(y, x) for y in (1, 2) for x in (2, 3)} and min(seen.values()) > 100  # 150 each


# transforms


def test_dft(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=15).tolist()) for k in range(7)]
    d = spark.createDataFrame(rows, "k int, x array<double>")
    got = {r.k: np.array(r.s.re) + 1j * np.array(r.s.im) for r in d.select("k", tensors.centred_dft("x", (3, 5)).alias("s")).collect()}
    for k, x in rows:
        a = np.array(x).reshape(3, 5)
        want = [[sum(a[y, z] * np.exp(-2j * np.pi * ((u - 1) * (y - 1) / 3 + (v - 2) * (z - 2) / 5)) for y in range(3) for z in range(5)) for v in range(5)] for u in range(3)]
        assert np.allclose(got[k], np.array(want).reshape(-1))
    rowwise = {r.k: np.array(r.s.re) + 1j * np.array(r.s.im) for r in d.select("k", tensors.centred_dft("x", (3, 5), inverse=True, axes=(1,)).alias("s")).collect()}
    a = np.array(rows[0][1]).reshape(3, 5)
    assert np.allclose(rowwise[0].reshape(3, 5), np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(a, 1), axis=1), 1))
    assert d.limit(0).select(tensors.centred_dft("x", (15,)).alias("s")).collect() == []


@pytest.mark.parametrize("n,bins", [(15, 4), (15, 40), (1, 1), (2, 9)])
def test_zoomed_dft(spark, n, bins):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=n).tolist()) for k in range(3)]
    d = spark.createDataFrame(rows, "k int, x array<double>")
    f = np.array(d.select(tensors.bin_centres(-0.7, 1.9, bins).alias("f")).first().f)
    assert np.allclose(f, -0.7 + (np.arange(bins) + 0.5) * 2.6 / bins)
    for r in d.select("k", tensors.zoomed_dft("x", n, 0.3, -0.7, 1.9, bins).alias("s")).collect():
        want = [sum(v * np.exp(-2j * np.pi * q * 0.3 * (i - (n - 1) / 2)) for i, v in enumerate(rows[r.k][1])) for q in f]
        assert np.allclose(np.array(r.s.re) + 1j * np.array(r.s.im), want)


# dependencies, pairs, texts


def test_dependency_levels(spark):
    rnd = random.Random(6)
    edges = [(a, b) for a in range(40) for b in range(a) if rnd.random() < 0.06] + [(3, 1), (3, 1), (50, 51), (51, 52), (52, 50), (53, 51), (60, 2), (None, 1), (1, None)]
    want = {}
    for a in range(40):
        want[a] = max((want[b] + 1 for x, b in edges if x == a and b is not None), default=0)
    want |= {50: None, 51: None, 52: None, 53: None, 60: want[2] + 1, 99: 0}
    nodes = spark.createDataFrame([(n,) for n in (*range(40), 99, None)], "node int")
    levels = joins.dependency_levels(nodes, spark.createDataFrame(edges, "node int, needs int"), "node", "needs")
    assert {r.node: r.level for r in levels.collect()} == want
    with pytest.raises(Exception, match="cycle at or before node 5"):
        joins.dependency_order(levels, "node").collect()
    order = [r.node for r in joins.dependency_order(levels.where("node < 40"), "node").collect()]
    assert all(order.index(a) > order.index(b) for a, b in edges if a is not None and a < 40 and b is not None)
    assert joins.dependency_levels(nodes.limit(0), spark.createDataFrame([], "node int, needs int"), "node", "needs").collect() == []


def test_derived_pairs(spark):
    low = [("a/x/image1.png",), ("a/x/image2.png",), ("a/y/image1.png",), ("a/z/image7.tar.gz",), (None,)]
    high = [("GT/sharp1.png",), ("GT/sharp1.jpg",), ("GT/sharp2.png",), ("GT/sharp9.png",)]
    pairs = joins.derived_pairs(spark.createDataFrame(low, "path string"), spark.createDataFrame(high, "path string"), "path", joins.stem_key("path", 5, "sharp"), joins.stem_key("path"))
    got = sorted((tuple(r) for r in pairs.collect()), key=str)
    want = [(f"sharp{n}", f"a/{d}/image{n}.png", f"GT/sharp{n}.{e}", "paired") for n, d, e in ((1, "x", "png"), (1, "x", "jpg"), (1, "y", "png"), (1, "y", "jpg"), (2, "x", "png"))]
    want += [("sharp7.tar", "a/z/image7.tar.gz", None, "no_high"), ("sharp9", None, "GT/sharp9.png", "no_low")]
    assert got == sorted(want, key=str)
    assert tuple(joins.pair_completeness(pairs).first()) == (5, 3, 3, 1, 1, False)
    none = pairs.where("false")
    assert tuple(joins.pair_completeness(none).first()) == (0, 0, 0, 0, 0, True)
    assert spark.createDataFrame([("a/b/c.png",)], "p string").select(joins.folder_key("p"), joins.folder_key("p", 2)).first()[:] == ("b", "a")


def test_table_texts(spark):
    rows = [("first", 1, 2, "x", 1.5, True, None), ("first", 1, 1, None, -20.25, None, None), ("other", 0, 1, "longer text", None, False, None)]
    d = spark.createDataFrame(rows, "t string, p int, n int, word string, v double, b boolean, none string")
    cells_ = stores.table_cells(d, F.col("t"), F.col("p"), ["n"], ["word", "v", "b"])
    text = stores.joined_tables(stores.text_of_tables(cells_).withColumn("set", F.lit(1)), ["set"]).first().text
    other = "other\n  word         v  b\n  ---------------------------\n  longer text  -  -\n"
    first = "first\n  word  v       b\n  -------------------------\n  -     -20.25  -\n  x        1.5  X\n"
    assert text == other + "\n" + first
    bare = stores.text_of_tables(cells_.where("t = 'first' AND i < 2"), "", 1, False).first().text
    assert bare == "first\nword v     \n-    -20.25\nx       1.5\n"
    none = stores.text_of_tables(stores.table_cells(d.where("n = 2"), F.col("t"), F.col("p"), ["n"], ["none", "n"], keys=("word",)), keys=("word",)).first()
    assert none.word == "x" and none.text == "first\n  none  n\n  -----------------\n     -  2\n"
    assert stores.aligned(d.where("t = 'other'").select("v"), 2).first().v == " "


# rays


def test_rays(spark):
    rnd = random.Random(7)
    rows = [(k, [rnd.uniform(-0.3, 0.3), rnd.uniform(-0.3, 0.3), rnd.choice((-2.0, 0.0, 1.5))], [rnd.uniform(-0.2, 0.2), rnd.uniform(-0.2, 0.2), rnd.choice((-1.0, 1.0))], rnd.choice((0.0, 1e-12, 0.4, -0.7, 1.1))) for k in range(80)]
    rows += [(90, [5.0, 0.0, 0.0], [0.0, 0.0, 1.0], 1.0), (91, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], 0.0)]
    d = spark.createDataFrame(rows, "k int, o array<double>, v array<double>, c double").withColumn("u", C.unit(F.col("v")))
    h = d.withColumn("h", C.sphere_hit(F.col("o"), F.col("u"), "c"))
    got = {r.k: r for r in h.withColumn("r", C.refracted(F.col("u"), F.col("h.normal"), F.lit(1.6))).collect()}
    assert not got[90].h.defined and not got[91].h.defined
    for k, o, v, c in rows[:80]:
        u, r = np.array(v) / np.linalg.norm(v), got[k]
        p, n = np.array(r.h.point), np.array(r.h.normal)
        assert r.h.defined and np.allclose(p, np.array(o) + r.h.t * u) and abs(c * (p @ p) - 2 * p[2]) < 1e-9 and c * p[2] < 1
        assert abs(np.linalg.norm(n) - 1) < 1e-12 and n @ u <= 0 and np.allclose(np.cross(n, [c * p[0], c * p[1], c * p[2] - 1]), 0)
        sine = 1.6 * np.linalg.norm(np.cross(u, n))
        assert r.r.defined == (sine <= 1)
        if sine <= 1:
            out = np.array(r.r.direction)
            assert abs(np.linalg.norm(np.cross(out, n)) - sine) < 1e-9 and out @ n < 0 and abs(np.cross(u, n) @ out) < 1e-9
    zero = spark.range(1).select(C.sphere_hit(F.array(*map(F.lit, (0.0, 0.0, -1.0))), F.array(*map(F.lit, (0.0, 0.0, 1.0))), F.lit(0.0)).alias("h")).first().h
    assert zero.t == 1.0 and zero.normal == [0.0, 0.0, -1.0]


def test_zernike_modes(spark):
    known = [(0, 0), (1, 1), (1, -1), (2, 0), (2, -2), (2, 2), (3, -1), (3, 1), (3, -3), (3, 3), (4, 0), (4, 2), (4, -2), (4, 4), (4, -4)]
    got = [(r.z.n, r.z.m) for r in spark.range(1, 16).select(C.zernike_mode("id").alias("z")).collect()]
    assert got == known
    big = spark.range(1, 30_000).select(C.zernike_mode("id").alias("z")).select("z.*")
    assert big.where("n < abs(m) OR (n - abs(m)) % 2 <> 0").isEmpty() and big.distinct().count() == 29_999
