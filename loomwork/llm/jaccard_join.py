"""Operator 13: n-gram Jaccard join with set-relation skipping.

Two documents link when their sets of 3-word shingles (64-bit fingerprints) have a similarity of 90
percent or more. The result is the component of each document, so exact copies and groups of near
copies are never expanded into pairs.

1. Prints. One pass over the texts gives each row its set's size and a 128-bit digest of the set.
2. Shared tokens. A set links only if 90 percent of its tokens occur in other sets. Each slice of rows
   sends its tokens, sorted by hash range and packed, to the task of the range, which says how many
   tokens of each row occur elsewhere. A token that several rows of a slice have is sent once, so a very
   common one costs an entry for each slice, not for each row. Only rows that may link go on; equal sets
   become one class, and the classes are asked once more.
3. Index. Tokens are ordered by the number of classes that hold them, rarest first. The first tokens of
   a class, as many as leave fewer than 90 percent behind them, are its entries in the inverted lists;
   tokens of no other class come first in that order and need no entry.
4. Derived answers. In each block of a list one class of the list's largest component is the leader that
   classes of other components ask, where sizes and positions permit a link: one question for each class
   in a round, and followers whose answer is a link join the leader's component. A list that stands wholly
   in one component is skipped from then on.
5. The rest is joined exactly, in turns: first a few classes are compared with all others, then many
   times as many, and so on until all are. Each pair has its turn and is compared then, unless earlier ones have
   already brought both into one component, which spares most pairs of a group. A list is cut into blocks by set size. An entry's size and position bound
   the sizes of its partners, so it probes only blocks in that range and skips the others; within a block
   the positions of both entries bound the overlap. A candidate of a follower is answered from its
   leader's overlap: |F & T| = |L & T| - |(L - F) & T| + |(F - L) & T|, and is skipped when
   |L & T| + |F - L| is too small. No filter loses a link, and no list or block is capped.

All joins on lists, classes and rows are equi-joins that Spark may split; blocks of questions are bounded.
Tables between steps are written.

Edge cases: a text with fewer than 3 words is one shingle of all its words; without words (or null) its
set is empty and it is linked with nothing; equal sets are linked; rows repeated with one doc_id are
documents of their own that report the same doc_id; a row without a doc_id is linked as any other, its
component_id is the smallest doc_id that it reaches (null if none); an empty table gives none; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.near_dedup import _digest, moved, shingle_sets
from loomwork.llm.shared import written
from loomwork.llm.text_arrays import byte_slices

WORDS, THRESHOLD = 3, 90  # words of a shingle; similarity in percent
RANGE = 2_000_000  # tokens of a hash range, on average
SLICE = 8 << 20  # bytes of texts or sets that are packed at a time
ROUNDS, FAIR = 10, 0.2  # most rounds, and the part of its questions that a round links if another one follows
BLOCK = 256  # questions of a block
FIRST, GROWTH = 32, 8  # so many classes of the longest list are compared with all others in the first turn; how many times more in each next one
RATIO = 1.03  # sizes of one block of a list lie within this ratio
FEW = 500_000  # so many row numbers at most are sent to all tasks; more are shuffled

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def prints(rows: DataFrame) -> DataFrame:
    """place, doc_id, n, cls (16 bytes; null for an empty set) of rows (place, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(2)):
                sets = shingle_sets(data, offsets, WORDS)
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.record_batch([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())], names=["place", "doc_id", "n", "cls"])

    return rows.mapInArrow(run, "place long, doc_id long, n long, cls binary")


def text_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Numbers and sets of slices of a batch (number, text)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in byte_slices(batch.column(1), SLICE):
        yield ids[lo:hi], shingle_sets(data, offsets, WORDS)


def packed_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Numbers and sets of slices of a batch (number, packed set)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in byte_slices(batch.column(1), 8 * SLICE):
        tokens = data.view(np.uint64)
        yield ids[lo:hi], [tokens[a:b] for a, b in zip(offsets[:-1] // 8, offsets[1:] // 8, strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte: the upper bytes of small ones compress in the shuffle."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def shared_tokens(rows: DataFrame, sets_of: Callable, total: int) -> DataFrame:
    """id, k: how many tokens of each row's set occur in other rows too (0: no row); too many at hash collisions only.

    `rows` has a number and what `sets_of` makes sets of; `total` is the number of their tokens.
    """
    parts = max(1, -(-total // RANGE))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in sets_of(batch):
                h = np.concatenate([np.zeros(0, np.uint64), *sets])
                own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                full = ((h >> _32) * np.uint64(parts) >> _32 << _32) | (h & _LOW)
                order = np.argsort(full, kind="stable")
                full, own = full[order], own[order]
                first = np.ones(len(full), bool)
                first[1:] = full[1:] != full[:-1]
                run = np.diff(np.append(np.flatnonzero(first), len(full)))
                many = np.repeat(run > 1, run)
                cuts = np.searchsorted(full, np.arange(parts + 1, dtype=np.uint64) << _32)
                name = xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1
                out = []
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[p], cuts[p + 1])
                    there, idx = np.unique(own[part], return_inverse=True)
                    key, several = full[part] & _LOW, many[part]
                    single = key[~several]
                    gaps = np.diff(single, prepend=np.uint64(0))
                    out.append((p, name, ids[there].tobytes(), _planes(np.bincount(idx[several], minlength=len(there))), _planes(gaps), _planes(idx[~several]), _planes(key[several & first[part]])))
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], names=["p", "slice", "ids", "own", "gaps", "idx", "several"])

    def count(table: pa.Table) -> pa.Table:
        ids, own, gaps, idx, several = (table.column(x).to_pylist() for x in ("ids", "own", "gaps", "idx", "several"))
        keys = [np.cumsum(_numbers(x), dtype=np.uint64) for x in gaps]
        ends = np.cumsum([len(x) for x in keys])
        key = np.concatenate(keys)
        order = np.argsort(key)
        ranked = key[order]
        same = np.zeros(len(key), bool)
        same[1:] = ranked[1:] == ranked[:-1]
        same[:-1] |= same[1:]
        common = np.unique(np.concatenate([_numbers(x) for x in several]))
        if len(common):
            at = np.minimum(np.searchsorted(common, ranked), len(common) - 1)
            same |= common[at] == ranked
        shared = np.zeros(len(key), bool)
        shared[order] = same
        out_id, out_k = [], []
        for k, end in enumerate(ends.tolist()):
            who = np.frombuffer(ids[k], np.int64)
            n = _numbers(own[k]) + np.bincount(_numbers(idx[k])[shared[end - len(keys[k]) : end]], minlength=len(who))
            out_id.append(who[n > 0].tobytes())
            out_k.append(_planes(n[n > 0]))
        return pa.table({"slice": table.column("slice"), "ids": pa.array(out_id, pa.binary()), "k": pa.array(out_k, pa.binary())})

    def total_of(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        who, at = np.unique(ids, return_inverse=True)
        k = np.bincount(at, np.concatenate([_numbers(x) for x in table.column("k").to_pylist()]), len(who))
        return pa.table({"id": pa.array(who, pa.int64()), "k": pa.array(k.astype(np.int64), pa.int64())})

    sent = rows.mapInArrow(send, "p int, slice long, ids binary, own binary, gaps binary, idx binary, several binary")
    counted = sent.groupBy("p").applyInArrow(count, "slice long, ids binary, k binary")  # packed: a row for each slice and range
    return counted.groupBy("slice").applyInArrow(total_of, "id long, k long").groupBy("id").agg(F.sum("k").alias("k"))


def _least(n: str, percent: int) -> Column:
    """The fewest tokens that a set of n shares with a linked one."""
    return F.expr(f"({n} * {percent} + 99) div 100")


def _some(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of `df` whose `column` is in `ids` (one column, distinct): looked up in a broadcast of at most FEW numbers, else by a shuffle."""
    (name,) = ids.columns
    ids = ids.withColumnRenamed(name, "some_")
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge"), F.col(column) == F.col("some_"), "left_semi")


def class_sets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """c, n, set (packed) of the classes (place, cls, c, n), each from one row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, WORDS)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["own_place", "own_cls", "set"])

    made = _some(rows.select("place", "text"), "place", classes.select("place")).mapInArrow(run, "own_place long, own_cls binary, set binary")
    held = classes.hint("merge").join(made, (F.col("place") == F.col("own_place")) & (F.col("cls") == F.col("own_cls")))
    return held.dropDuplicates(["place", "cls"]).select("c", "n", "set")


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """c, n, set (packed: the tokens that other sets hold too), start, first of sets (c, n, set).

    `first` has the tokens of the lists that the set is in; the first of them is its token number `start`
    in the order of the number of sets that hold a token. Sets that can't link are left out.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, data, offsets in byte_slices(batch.column(2)):
                many = np.diff(offsets) // 8
                yield pa.record_batch([pa.array(np.repeat(c[lo:hi], many)), pa.array(np.repeat(n[lo:hi], many)), pa.array(data.view(np.int64))], names=["c", "n", "token"])

    def sets_in(c: np.ndarray, n: np.ndarray, token: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(c)) + 1
        out = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(c)], strict=True):
            size, k = int(n[a]), b - a
            least = -(-size * percent // 100)
            if k >= least:
                out.append((int(c[a]), size, np.sort(token[a:b].view(np.uint64)).tobytes(), size - k, token[a : a + k - least + 1].tolist()))
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["c", "n", "set", "start", "first"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the tokens of the last set so far
        for batch in batches:
            held = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield from sets_in(*[x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield from sets_in(*held)

    tokens = sets.select("c", "n", "set").mapInArrow(spread, "c long, n long, token long")
    several = tokens.groupBy(F.col("token").alias("s_token")).agg(F.count("*").alias("df")).where("df > 1")
    tokens = tokens.join(several.hint("merge"), F.col("token") == F.col("s_token")).select("c", "n", "token", "df")
    return tokens.repartition("c").sortWithinPartitions("c", "df", "token").select("c", "n", "token").mapInArrow(gather, "c long, n long, set binary, start long, first array<long>")


def answered(asks: DataFrame, body: DataFrame, percent: int) -> DataFrame:
    """a, b: the links among the questions (l, f, t), whether f and t are linked, where l is f or a set much like it.

    Questions of one leader meet in blocks. The overlap of l and t is counted once; that of f and t follows from it.
    """

    def run(sets: pa.Table, asked: pa.Table) -> pa.Table:
        full = {c: (n, np.frombuffer(s, np.uint64)) for c, n, s in zip(*(sets.column(x).to_pylist() for x in ("c", "n", "set")), strict=True)}

        def common(x: np.ndarray, y: np.ndarray) -> int:
            if not len(x) or not len(y):
                return 0
            return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())

        with_leader: dict[int, int] = {}
        changes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for leader, f, t in zip(*(asked.column(x).to_pylist() for x in ("l", "f", "t")), strict=True):
            (_, lead), (n, mine), (m, other) = full[leader], full[f], full[t]
            if t not in with_leader:
                with_leader[t] = common(*sorted((other, lead), key=len))
            overlap = with_leader[t]
            if f != leader:
                if f not in changes:
                    changes[f] = np.setdiff1d(lead, mine, assume_unique=True), np.setdiff1d(mine, lead, assume_unique=True)
                gone, new = changes[f]
                if (100 + percent) * (overlap + len(new)) < percent * (n + m):
                    continue
                overlap += common(new, other) - common(gone, other)
            if (100 + percent) * overlap >= percent * (n + m):
                out.append((f, t))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    dealt = asks.groupBy(F.col("l").alias("d_l")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    asks = asks.join(dealt, F.col("l") == F.col("d_l")).select("l", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int").alias("j"), "f", "t")
    asks = written(asks, "jaccard-asks")
    wanted = [asks.select(F.col("l").alias("w_l"), F.col("j").alias("w_j"), F.col(c).alias("w_c")).distinct() for c in "lft"]
    wanted = wanted[0].unionByName(wanted[1]).unionByName(wanted[2]).distinct()
    sets = wanted.join(body.select("c", "n", "set").hint("merge"), F.col("w_c") == F.col("c")).select("w_l", "w_j", "c", "n", "set")
    return sets.groupBy("w_l", "w_j").cogroup(asks.groupBy("l", "j")).applyInArrow(run, "a long, b long")


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """key, c, n, g, comp of the lists in which two or more components stand. Written once."""
    m = lists.join(labels, "c")
    several = m.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    return written(m.join(several, F.col("key") == F.col("k"), "left_semi").select(*lists.columns, "comp"), "jaccard-open")


def turns(lists: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """`lists` with turn, and the number of turns: in each one GROWTH times as many classes as before, all others in the last.

    Turns are as many as it takes for a list of the `longest` length to begin with some FIRST of its classes.
    """
    n = 0
    while FIRST * GROWTH**n < longest:
        n += 1
    h = F.pmod(F.xxhash64("c", F.lit("turn")), F.lit(GROWTH**n))
    turn = F.lit(n)
    for k in reversed(range(n)):
        turn = F.when(h % GROWTH ** (n - k) == 0, k).otherwise(turn)
    return lists.withColumn("turn", turn), n + 1


def _block(n: str) -> Column:
    """The block of a list in which sets of this size stand."""
    return F.floor(F.log(F.col(n).cast("double")) / float(np.log(RATIO))).cast("int")


def _probes(members: DataFrame, percent: int, largest: str) -> DataFrame:
    """key, x, xn, xg, x_comp, least, most, block: each entry once for each block that can hold a partner, of at most `largest` tokens.

    The fewest tokens of a partner follow from the size of a set, the most from its entry's position too.
    """
    most = f"least({largest}, ({100 + percent} * (n - g) - {percent} * n) div {percent})"
    p = members.withColumnsRenamed({"c": "x", "n": "xn", "g": "xg", "comp": "x_comp"}).withColumn("n", F.col("xn")).withColumn("g", F.col("xg"))
    p = p.withColumn("least", _least("n", percent)).withColumn("most", F.expr(most)).where("most >= least").drop("n", "g")
    return p.withColumn("block", F.explode(F.sequence(_block("least"), _block("most"))))


def _fits(percent: int) -> str:
    return f"yn BETWEEN least AND most AND {100 + percent} * least(xn - xg, yn - yg) >= {percent} * (xn + yn)"


def leader_asks(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """l, f, t (l = f): for each class outside the largest component of a list one leader that sizes and positions permit.

    Each block of a list has one leader, of the list's largest component: at first the set with the fewest
    tokens of its own, which the others are nearest to, later any.
    """
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("many"))
    largest = parts.groupBy(F.col("key").alias("m_key")).agg(F.max(F.struct("many", "comp")).alias("m")).select("m_key", F.col("m.comp").alias("main"))
    m = members.join(largest, F.col("key") == F.col("m_key")).drop("m_key")
    rank = F.col("g") if turn == 0 else F.xxhash64("c", F.lit(turn))
    leaders = m.where("comp = main").groupBy(F.col("key").alias("y_key"), _block("n").alias("y_block")).agg(F.min(F.struct(rank.alias("rank"), F.col("c").alias("y"), F.col("n").alias("yn"), F.col("g").alias("yg"))).alias("p"))
    probes = _probes(m.where("comp <> main").drop("main"), percent, f"n * 100 div {percent}")
    j = probes.join(leaders.select("y_key", "y_block", "p.*"), (F.col("key") == F.col("y_key")) & (F.col("block") == F.col("y_block")) & F.expr(_fits(percent)))
    best = j.groupBy(F.col("x").alias("t")).agg(F.min(F.struct("rank", "y")).alias("p"))
    return best.select(F.col("p.y").alias("l"), F.col("p.y").alias("f"), "t")


def candidates(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """x, y: the pairs of this turn that are in different components, share a list (key, c, n, g, turn, comp) and that sizes and positions permit."""
    index = members.select(F.col("turn").alias("y_turn"), F.col("key").alias("i_key"), F.col("c").alias("y"), F.col("n").alias("yn"), F.col("g").alias("yg"), F.col("comp").alias("y_comp"), _block("n").alias("i_block"))
    on = (F.col("key") == F.col("i_key")) & (F.col("block") == F.col("i_block")) & F.expr(f"x_comp <> y_comp AND (yn < xn OR y < x) AND least(turn, y_turn) = {turn} AND {_fits(percent)}")
    return _probes(members, percent, "n").join(index.hint("merge"), on).select("x", "y").distinct()


def joined(docs: DataFrame, rounds: int = ROUNDS, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    # a row is found again by its own text and doc_id
    rows = docs.select(F.xxhash64("doc_id", "text").alias("place"), "doc_id", "text")
    every = written(prints(rows), "jaccard-prints")
    total = every.agg(F.sum("n")).first()[0] or 0
    shared = written(shared_tokens(rows.select("place", "text"), text_sets, total), "jaccard-shared")
    live = every.where("cls IS NOT NULL").join(shared, F.col("place") == F.col("id")).where(F.col("k") >= _least("n", percent))
    classes = live.groupBy("cls").agg(F.min("place").alias("place"), F.min("n").alias("n"), F.min("doc_id").alias("first_id"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "jaccard-classes")
    sets = written(class_sets(rows, classes), "jaccard-sets")
    total = classes.agg(F.sum("n")).first()[0] or 0
    shared = shared_tokens(sets.select("c", "set"), packed_sets, total)
    able = written(classes.join(shared, F.col("c") == F.col("id")).where(F.col("k") >= _least("n", percent)).select("c"), "jaccard-able")
    body = written(ordered_sets(_some(sets, "c", able), percent), "jaccard-body")
    lists = written(body.select("c", "n", "start", F.posexplode("first").alias("pos", "key")).select("key", "c", "n", (F.col("start") + F.col("pos")).alias("g")), "jaccard-lists")
    labels = body.select("c", F.col("c").alias("comp"))
    members = open_lists(lists, labels)
    leads = body.select(F.col("c").alias("a"), F.col("c").alias("b")).where("false")
    for turn in range(rounds):
        asks = written(leader_asks(members, turn, percent), f"jaccard-asks{turn}")
        found = written(answered(asks, body, percent), f"jaccard-links{turn}")
        asked, links = asks.count(), found.count()
        if links:
            leads = leads.unionByName(found)
            labels = moved(labels, found)
            members = open_lists(lists, labels)
        if links <= FAIR * asked:
            break
    leads = written(leads.groupBy(F.col("b").alias("follower")).agg(F.min("a").alias("leader")), "jaccard-leads")
    x, y = (leads.withColumnsRenamed({"follower": f"{s}_f", "leader": f"{s}_l"}) for s in "xy")
    by_x = F.col("x_l").isNotNull() | F.col("y_l").isNull()
    longest = members.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    lists, n_turns = turns(lists, longest)
    for turn in range(n_turns):
        pairs = candidates(open_lists(lists, labels), turn, percent).join(x, F.col("x") == F.col("x_f"), "left").join(y, F.col("y") == F.col("y_f"), "left")
        asks = pairs.select(F.coalesce("x_l", "y_l", "x").alias("l"), F.when(by_x, F.col("x")).otherwise(F.col("y")).alias("f"), F.when(by_x, F.col("y")).otherwise(F.col("x")).alias("t"))
        found = written(answered(written(asks, "jaccard-rest"), body, percent), "jaccard-links")
        if not found.isEmpty():
            labels = moved(labels, found)
    labels = labels.select(F.col("c").alias("l_c"), "comp")
    known = classes.join(labels, F.col("c") == F.col("l_c"), "left").select("cls", "first_id", F.coalesce("comp", "c").alias("comp"))
    least = known.groupBy(F.col("comp").alias("g")).agg(F.min("first_id").alias("least_id"))
    known = known.join(least, F.col("comp") == F.col("g")).select(F.col("cls").alias("k_cls"), "least_id")
    out = every.join(known, F.col("cls") == F.col("k_cls"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least_id", "doc_id").alias("component_id"))
