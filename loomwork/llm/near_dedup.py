"""Operator 6: MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts makes, per row, the set of its 5-word shingles (64-bit fingerprints), a
   128-bit fingerprint of the whole set, and a MinHash signature. Rows with equal sets form a class,
   named by the number of one of its rows; from here on only classes are compared, so exact copies
   cost one row each and no pairs.
2. Signatures are banded. A band that two or more classes share is a bucket.
3. Rounds: in each bucket where two or more components stand, the component with most members gives a
   pivot, its first member in the order of a hash of the round. Every class of another component
   meets one pivot, the first of those in its buckets; buckets of one group mostly choose alike. So a
   round compares at most one pair for each class, and links found join components. Rounds go on as
   long as they link a fair part of the classes they ask.
4. What is left are buckets with several components; a bucket of two classes that a round has compared
   is left out. Each class that is not in its bucket's largest component is a stray of that component and
   meets those classes of other components that share a bucket with it, in the block of the first bucket
   they share and only if no round has compared the two. So every pair that shares a band and is not yet
   in one component is compared, and none twice.

Comparing: signatures are compared in batches of hashes, and a pair is pruned as soon as the
posterior chance of a similarity of at least the threshold falls below the chosen miss probability.
Survivors are verified exactly on their full sets. Pairs meet in blocks, of one pivot or of strays and
classes, and only links leave a block; blocks are bounded in rows and, but for a single large set, in
bytes.

Joins that move signatures, texts or sets always deal both sides by key (merge joins), at every size of
the input, so that what is measured on small inputs holds for large ones.

Edge cases: a text with fewer than 5 words is one shingle of all its words; without words (or null)
its set is empty and it is linked with nothing; equal sets are linked; rows repeated with one doc_id
are documents of their own that report the same doc_id; a row without a doc_id is linked as any other,
its component_id is the smallest doc_id that it reaches (null if none), and kept is false, or null
where component_id is null; an empty table gives none; further columns are ignored, whatever their
names. `drop_near_copies` keeps one row of each component: of its smallest doc_id the first row, a null
doc_id after all others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import kept_rows, numbered, written
from loomwork.llm.text_arrays import LOWER, byte_slices, mix, ngram_hashes, word_hashes, word_spans

WORDS, THRESHOLD = 5, 75  # words of a shingle; similarity in percent
BANDS, ROWS = 48, 5  # a pair at the threshold shares no band with a chance of 2e-6
BATCH = 40  # hashes that are compared before the next decision
MISS = 1e-9  # chance to prune a pair at the threshold or above
ROUNDS, FAIR = 8, 0.1  # most rounds, and the part of its pairs that a round links if another one follows
BLOCK = 256  # classes of either side of a block
BLOCK_BYTES = 4 << 20  # bytes of sets of either side
MANY, COLUMNS = 1_000, 4_096  # survivors of a block from which counts are taken by a matrix product, and its columns at a time
FEW = 100_000  # so many class numbers at most are sent to all tasks; more are shuffled

_N = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(6))
_A = _rng.integers(1, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, _N, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    grams = ngram_hashes(h, n)
    out = []
    for k, c in enumerate(counts):
        a = bounds[k]
        if c >= n:
            out.append(np.unique(grams[a : a + c - n + 1]))
        elif c:
            out.append(mix(np.uint64(c) + ngram_hashes(h[a : a + c], int(c))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A MinHash signature (the upper 16 bits of each minimum) for each set that isn't empty."""
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    out = np.empty((len(sets), _N), dtype=np.uint16)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    step = 1 << 16  # values at a time, so that they stay in the cache; a set is never split over two rows
    lo = 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, side="right")) - 1)
        hi = len(sets) if at[-1] - at[lo] < step else hi
        part, own = h[at[lo] : at[hi - 1] + sizes[hi - 1]], at[lo:hi] - at[lo]
        for k in range(_N):
            out[lo:hi, k] = (np.minimum.reduceat(part * _A[k] + _B[k], own) >> np.uint64(48)).astype(np.uint16)
        lo = hi
    return out


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set: its size in with a sum and a sum of remixed members."""
    n = np.uint64(len(s))
    with np.errstate(over="ignore"):
        return np.array([np.add.reduce(mix(s + np.uint64(11))) + n, np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], dtype=np.uint64).tobytes()


def fingerprints(rows: DataFrame) -> DataFrame:
    """row, place, doc_id, n_shingles, cls (16 bytes; null for an empty set), sig of rows (row, place, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(3)):
                sets = shingle_sets(data, offsets)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = iter(signatures([sets[k] for k in full]))
                cls = [_digest(s) if len(s) else None for s in sets]
                sigs = [next(sig).tobytes() if len(s) else None for s in sets]
                own = [batch.column(k).slice(lo, hi - lo) for k in range(3)]
                yield pa.record_batch([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(sigs, pa.binary())], names=["row", "place", "doc_id", "n_shingles", "cls", "sig"])

    return rows.mapInArrow(run, "row long, place long, doc_id long, n_shingles long, cls binary, sig binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """key, c, n of every band that at least two classes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).astype(np.uint64).reshape(n, BANDS, ROWS)
            key = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            which = pa.array(np.repeat(np.arange(n), BANDS))
            yield pa.record_batch([pa.array(key.reshape(-1).astype(np.int64)), batch.column(0).take(which), batch.column(1).take(which)], names=["key", "c", "n"])

    bands = nodes.select("c", "n", "sig").mapInArrow(run, "key long, c long, n int")
    shared = bands.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select(F.col("key").alias("k"))
    return bands.join(shared.hint("merge"), F.col("key") == F.col("k"), "left_semi")


@functools.cache
def fewest_matches(n: int, threshold: float = THRESHOLD / 100, miss: float = MISS) -> int:
    """The fewest matches of `n` hashes with which P(similarity >= threshold) is at least `miss`.

    The prior is uniform, so the posterior after m matches is Beta(m + 1, n - m + 1).
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        log_p = m * np.log(s) + (n - m) * np.log1p(-s)
        p = np.exp(log_p - log_p.max())
        if p[s >= threshold].sum() / p.sum() >= miss:
            return m
    return n


def _steps(percent: int, miss: float) -> list[tuple[int, int, int]]:
    """Batches of hashes (from, to), and the fewest matches up to there with which a pair stays."""
    return [(hi - BATCH, hi, fewest_matches(hi, percent / 100, miss)) for hi in range(BATCH, _N + 1, BATCH)]


def _similar(sig: np.ndarray, x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) that no batch prunes."""
    matches = np.zeros(len(x), np.int64)
    for lo, hi, least in steps:
        matches += (sig[x, lo:hi] == sig[y, lo:hi]).sum(axis=1)
        go = matches >= least
        x, y, matches = x[go], y[go], matches[go]
    return x, y


def _some(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `df` whose `c` is in `ids`: looked up in a broadcast table of at most FEW numbers, else by a shuffle."""
    ids = ids.select(F.col("c").alias("own_c")).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids, F.col("c") == F.col("own_c"), "left_semi")


def _common(full: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The size of the intersection of each pair of sets (x, y)."""
    if len(x) < MANY:
        return np.array([len(np.intersect1d(full[u], full[v], assume_unique=True)) for u, v in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    rows, cols = np.unique(x), np.unique(y)
    sides = [(np.concatenate([full[k] for k in own]), np.repeat(np.arange(len(own)), [len(full[k]) for k in own])) for own in (rows, cols)]
    both = np.intersect1d(*[values for values, _ in sides])
    found = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        real = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[real], kind="stable")
        found.append((at[real][order], owner[real][order]))
    counts = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(both), COLUMNS):
        part = []
        for (at, owner), n in zip(found, (len(rows), len(cols)), strict=True):
            a, b = np.searchsorted(at, [lo, lo + COLUMNS])
            m = np.zeros((n, COLUMNS), np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            part.append(m)
        counts += part[0] @ part[1].T
    return counts[np.searchsorted(rows, x), np.searchsorted(cols, y)].astype(np.int64)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array column, and the row of each."""
    lists = column.combine_chunks()
    n = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), n)


def due_pairs(row: np.ndarray, c: np.ndarray, own: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], met: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which rows (`row`) and columns (the others) of a block are to be compared: a matrix.

    The first key that the two share must be one of the block's `own`, and neither has `met` the other.
    """
    rows, cols = np.flatnonzero(row), np.flatnonzero(~row)
    place = np.empty(len(row), np.int64)
    place[rows], place[cols] = np.arange(len(rows)), np.arange(len(cols))
    key, owner = np.concatenate([own[0], others[0]]), np.concatenate([own[1], others[1]])
    here = np.arange(len(key)) < len(own[0])
    order = np.argsort(key, kind="stable")
    key, owner, here = key[order], owner[order], here[order]
    first = np.zeros((len(rows), len(cols)), np.int8)
    cuts = np.flatnonzero(np.diff(key)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
        side = row[owner[lo:hi]]
        if side.any() and not side.all():
            at = np.ix_(place[owner[lo:hi][side]], place[owner[lo:hi][~side]])
            first[at] = np.where(first[at] == 0, 1 if here[lo] else 2, first[at])
    due = first == 1
    for (q, who), mine, theirs in ((met, rows, cols), (met, cols, rows)):
        order = np.argsort(c[theirs])
        theirs = theirs[order]
        at = np.minimum(np.searchsorted(c[theirs], q), max(len(theirs) - 1, 0))
        fits = np.isin(who, mine) & (c[theirs][at] == q) if len(theirs) else np.zeros(len(q), bool)
        x, y = place[who[fits]], place[theirs[at[fits]]]
        due[(x, y) if mine is rows else (y, x)] = False
    return due


def verified(blocks: DataFrame, body: DataFrame, percent: int = THRESHOLD, miss: float = MISS) -> DataFrame:
    """a, b: the links between the rows and the columns of blocks (main, i, j, c, comp, row, twice, own, others, met) that are in different components.

    `body` has c, sig and set; `twice` marks classes that are among the rows and the columns. Where a block has keys,
    its pairs are those of `due_pairs`. In a block, sizes rule links out, signatures prune batch by batch, and full sets
    verify the survivors.
    """
    steps = _steps(percent, miss)

    def run(table: pa.Table) -> pa.Table:
        row, comp, c, twice = (table.column(k).to_numpy(zero_copy_only=False) for k in ("row", "comp", "c", "twice"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, _N)
        full = [np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()]
        size = np.array([len(x) for x in full])
        row = row.astype(bool)
        columns = np.flatnonzero(~row)
        keyed = table.column("own").null_count < len(row)
        due = due_pairs(row, c, *(_lists(table.column(k)) for k in ("own", "others", "met"))) if keyed else None
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, r in enumerate(np.flatnonzero(row).tolist()):
            other = columns if due is None else columns[due[k]]
            y = other[(comp[other] != comp[r]) & (~twice[other] | ~twice[r] | (c[other] > c[r])) & (100 * np.minimum(size[other], size[r]) >= percent * np.maximum(size[other], size[r]))]
            x, y = _similar(sig, np.full(len(y), r), y, steps)
            xs.append(x)
            ys.append(y)
        x, y = np.concatenate(xs), np.concatenate(ys)
        common = _common(full, x, y)
        link = 100 * common >= percent * (size[x] + size[y] - common)
        return pa.table({"a": pa.array(c[x[link]], pa.int64()), "b": pa.array(c[y[link]], pa.int64())})

    return blocks.join(_some(body, blocks).hint("merge"), "c").groupBy("main", "i", "j").applyInArrow(run, "a long, b long")


def _parts(n_rows: Column, n_shingles: Column) -> Column:
    """How many blocks hold so many classes with so many shingles."""
    return F.greatest(F.lit(1), F.ceil(n_rows / BLOCK), F.ceil(8 * n_shingles / BLOCK_BYTES)).cast("int")


def pivot_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks of the pairs (q, q_comp, c, comp, n): one row, the pivot, and its classes. Written once."""
    dealt = pairs.groupBy("q", "q_comp").agg(_parts(F.count("*"), F.sum("n")).alias("parts"))
    place = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    cols = pairs.join(dealt.select(F.col("q").alias("main"), "parts"), F.col("q") == F.col("main"))
    cols = cols.select("main", F.lit(0).alias("i"), place.alias("j"), "c", "comp", F.lit(False).alias("row"), F.lit(False).alias("twice"))
    rows = dealt.select(F.col("q").alias("main"), F.lit(0).alias("i"), F.explode(F.expr("sequence(0, parts - 1)")).alias("j"), F.col("q").alias("c"), F.col("q_comp").alias("comp"), F.lit(True).alias("row"), F.lit(False).alias("twice"))
    none = F.lit(None).cast("array<long>")
    return written(cols.unionByName(rows).withColumns({"own": none, "others": none, "met": none}), "near-blocks")


def class_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """c and set (packed fingerprints) of the classes of `wanted` (place, cls, c), from one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1)):
                sets = shingle_sets(data, offsets)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["place", "own", "set"])

    text = rows.select("place", "text").join(wanted.select(F.col("place").alias("w")).hint("merge"), F.col("place") == F.col("w"), "left_semi")
    made = text.mapInArrow(run, "place long, own binary, set binary").join(wanted.withColumnRenamed("place", "w").hint("merge"), (F.col("place") == F.col("w")) & (F.col("own") == F.col("cls")))
    return made.select("c", "set").dropDuplicates(["c"])


def roots(links: DataFrame) -> DataFrame:
    """u, v: of each node of the links (a, b) that is not the smallest of its component, that smallest node.

    Large and small stars take turns: a node's larger neighbours, then its smaller ones, are linked to
    its smallest neighbour, until nothing moves. The edges are pairs of components, not of documents.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "near-edges")
    state = None
    while (now := tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != state:
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.col("x")).alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "near-edges")
    return edges


def moved(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (c, comp) after the components that the links (a, b) join."""
    own = [labels.select(F.col("c").alias(f"{x}_c"), F.col("comp").alias(f"{x}_comp")) for x in "ab"]
    comps = links.join(own[0], F.col("a") == F.col("a_c")).join(own[1], F.col("b") == F.col("b_c"))
    up = roots(comps.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    return written(labels.join(up, F.col("comp") == F.col("u"), "left").select("c", F.coalesce("v", "comp").alias("comp")), "near-labels")


def open_members(bucket: DataFrame, labels: DataFrame) -> DataFrame:
    """key, c, n, comp of the buckets in which two or more components stand."""
    m = bucket.select("key", "c", "n").join(labels, "c")
    several = m.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    return written(m.join(several, F.col("key") == F.col("k"), "left_semi").select("key", "c", "n", "comp"), "near-members")


def pivot_pairs(members: DataFrame, turn: int) -> DataFrame:
    """q, q_comp, c, comp, n: for each class outside the largest component of a bucket, one of its buckets' pivots."""
    order = F.struct(F.xxhash64("c", F.lit(turn)).alias("h"), "c")
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("many"), F.min(order).alias("o"))
    chosen = parts.groupBy(F.col("key").alias("k")).agg(F.min(F.struct((-F.col("many")).alias("few"), F.col("o"), F.col("comp").alias("q_comp"))).alias("p"))
    chosen = chosen.select("k", F.struct("p.o", "p.q_comp").alias("p"))
    best = members.join(chosen, F.col("key") == F.col("k")).where("comp <> p.q_comp").groupBy("c", "comp", "n").agg(F.min("p").alias("p"))
    return best.select(F.col("p.o.c").alias("q"), F.col("p.q_comp").alias("q_comp"), "c", "comp", "n")


def unmet(members: DataFrame, asked: DataFrame) -> DataFrame:
    """The members without the buckets of two classes that a round has compared (`asked`: q, c)."""
    two = members.groupBy("key").agg(F.count("*").alias("many"), F.min("c").alias("x"), F.max("c").alias("y")).where("many = 2")
    met = asked.select(F.least("q", "c").alias("m_x"), F.greatest("q", "c").alias("m_y")).distinct()
    done = two.join(met.hint("merge"), (F.col("x") == F.col("m_x")) & (F.col("y") == F.col("m_y")), "left_semi").select(F.col("key").alias("k"))
    return members.join(done.hint("merge"), F.col("key") == F.col("k"), "left_anti")


def stray_blocks(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of the classes that share a bucket across components. Written once.

    Each bucket belongs to the largest component in it; its other classes are strays of that component.
    Strays (rows) meet those classes of its buckets (columns) with which they share one. A class brings
    its keys, at most one for each band, and the pivots it has met (`asked`: q, c), one for each round at most.
    """
    members = unmet(members, asked)
    weight = members.select("comp", "c").distinct().groupBy(F.col("comp").alias("w")).agg(F.count("*").alias("many"))
    largest = members.select("key", "comp").distinct().join(weight, F.col("comp") == F.col("w")).groupBy(F.col("key").alias("k")).agg(F.max(F.struct("many", "comp")).alias("m"))
    d = members.join(largest.select("k", F.col("m.comp").alias("main")), F.col("key") == F.col("k"))
    d = d.groupBy("c", "comp", "n").agg(F.collect_list(F.struct("key", "main")).alias("keys"))
    met = asked.groupBy(F.col("c").alias("m_c")).agg(F.collect_list("q").alias("met"))
    d = d.join(met.hint("merge"), F.col("c") == F.col("m_c"), "left")
    d = d.withColumn("main", F.explode(F.array_distinct("keys.main")))
    here = lambda same: F.transform(F.filter("keys", lambda k: (k["main"] == F.col("main")) == F.lit(same)), lambda k: k["key"])
    d = written(d.select("main", "c", "comp", "n", here(True).alias("own"), here(False).alias("others"), "met"), "near-strays")
    stray = F.col("comp") != F.col("main")
    sizes = d.groupBy(F.col("main").alias("m")).agg(_parts(F.count_if(stray), F.sum(F.when(stray, F.col("n")).otherwise(0))).alias("rows"), _parts(F.count("*"), F.sum("n")).alias("cols"))
    d = d.join(sizes, F.col("main") == F.col("m"))
    place = lambda n, salt: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(n)).cast("int")
    own = ["own", "others", "met"]
    cols = d.select("main", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), place("cols", 2).alias("j"), "c", "comp", F.lit(False).alias("row"), stray.alias("twice"), *own)
    rows = d.where(stray).select("main", place("rows", 1).alias("i"), F.explode(F.expr("sequence(0, cols - 1)")).alias("j"), "c", "comp", F.lit(True).alias("row"), F.lit(True).alias("twice"), *own)
    return written(cols.unionByName(rows), "near-blocks")


def _components(rows: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The written fingerprints of rows (row, place, doc_id, text), and cls with its component's first doc_id and row.

    `place` finds a row's text again: equal texts may share it.
    """
    prints = written(fingerprints(rows), "near-prints")
    # one row of each class stands for it; which one does not matter, its set is the same
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(prints.where("cls IS NOT NULL").groupBy("cls").agg(F.min("row").alias("c"), F.min(first).alias("first")), "near-classes")
    one = prints.join(classes.select(F.col("c").alias("own_c")).hint("merge"), F.col("row") == F.col("own_c"), "left_semi").select(F.col("row").alias("c"), "place", "cls", F.col("n_shingles").cast("int").alias("n"), "sig")
    bucket = written(buckets(one), "near-buckets")
    nodes = written(one.join(bucket.select("c").distinct().hint("merge"), "c", "left_semi"), "near-nodes")
    body = written(nodes.select("c", "sig").join(class_sets(rows, nodes.select("place", "cls", "c")).hint("merge"), "c"), "near-body")
    labels = nodes.select("c", F.col("c").alias("comp"))
    members = bucket.withColumn("comp", F.col("c"))
    met = None
    for turn in range(rounds):
        pairs = written(pivot_pairs(members, turn), f"near-pairs{turn}")
        found = written(verified(pivot_blocks(pairs), body), f"near-links{turn}")
        asked, links = pairs.count(), found.count()
        met = pairs.select("q", "c") if met is None else met.unionByName(pairs.select("q", "c"))
        if links:
            labels = moved(labels, found)
            members = open_members(members, labels)
        if links <= FAIR * asked:
            break
    labels = moved(labels, verified(stray_blocks(members, met), body)).select(F.col("c").alias("l_c"), "comp")
    known = classes.join(labels, F.col("c") == F.col("l_c"), "left").select("cls", "first", F.coalesce("comp", "c").alias("comp"))
    least = known.groupBy(F.col("comp").alias("g")).agg(F.min("first").alias("least"))
    return prints, known.join(least, F.col("comp") == F.col("g")).select(F.col("cls").alias("k_cls"), F.col("least.doc_id").alias("least_id"), F.col("least.row").alias("least_row"))


def near_groups(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    # a row without a doc_id is found again by its text
    place = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), place.alias("place"), "doc_id", "text")
    prints, known = _components(rows, rounds)
    out = prints.join(known, F.col("cls") == F.col("k_cls"), "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.when(F.col("component_id").isNotNull(), F.lit(False))).alias("kept"))


def drop_near_copies(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row of each component, with the columns of the input."""
    docs, row = numbered(docs, "near-rows")
    rows = docs.select(F.col(row).alias("row"), F.col(row).alias("place"), "doc_id", "text")
    prints, known = _components(rows, rounds)
    out = prints.join(known, F.col("cls") == F.col("k_cls"), "left")
    return kept_rows(docs, row, out.where("cls IS NULL OR row = least_row").select("row"))
