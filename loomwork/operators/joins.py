"""Joins with the checks that callers rely on: completeness, order, tolerance, overlap, seeded picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import uniform
from loomwork.operators.rank import numbered
from loomwork.sources.shared import stored


def ready_items(done_upstream: list[DataFrame], handled: list[DataFrame], key: str = "item") -> DataFrame:
    """Keys that every upstream stage has done and none of the handled sets holds, in order."""
    ready = done_upstream[0].select(key).distinct()
    for d in done_upstream[1:]:
        ready = ready.join(d.select(key), key, "left_semi")
    for h in handled:
        ready = ready.join(h.select(key), key, "left_anti")
    return ready.orderBy(key)


def semi(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def lookup(df: DataFrame, dimension: DataFrame, on: str | list[str], strict: bool = False) -> DataFrame:
    """Left join to a dimension; strict: a missing key raises when the result is evaluated.

    The size of the dimension is left to Spark: it is broadcast only below the session's threshold.
    """
    if not strict:
        return df.join(dimension, on, "left")
    keys = [on] if isinstance(on, str) else on
    out = df.join(dimension.withColumn("found_", F.lit(True)), on, "left")
    message = F.concat(F.lit("missing key: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return out.where(F.when(F.col("found_").isNull(), F.raise_error(message).cast("boolean")).otherwise(True)).drop("found_")


def pair_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join of keys: key, in_a, in_b (rows of each side)."""
    x = a.groupBy(key).agg(F.count("*").alias("in_a"))
    y = b.groupBy(key).agg(F.count("*").alias("in_b"))
    return x.join(y, key, "full_outer").select(key, F.coalesce("in_a", F.lit(0)).cast("long").alias("in_a"), F.coalesce("in_b", F.lit(0)).cast("long").alias("in_b"))


def pair_by_name(a: DataFrame, b: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Inner join by key; with check, a key that only one side has raises when the result is evaluated."""
    if not check:
        return a.join(b, key)
    x, y = a.withColumn("a_", F.lit(1)), b.withColumn("b_", F.lit(1))
    out = x.join(y, key, "full_outer")
    bad = F.raise_error(F.concat(F.lit("no partner: "), F.col(key).cast("string"))).cast("boolean")
    return out.where(F.when(F.col("a_").isNull() | F.col("b_").isNull(), bad).otherwise(True)).drop("a_", "b_")


def pair_by_order(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], check: bool = True) -> DataFrame:
    """Join of the n-th rows of both sides; with check, unequal numbers of rows raise here."""
    if check and a.count() != b.count():
        raise ValueError("unequal numbers of rows")
    x, y = numbered(a, order_a, "rn"), numbered(b, order_b, "rn_b")
    return x.join(y, F.col("rn") == F.col("rn_b")).drop("rn_b")


def argmax_candidate(candidates: DataFrame, group: list[str], score: str, order: str, threshold: float) -> DataFrame:
    """The best candidate of each group (of ties the first by order), with n, best, others and confident.

    Confident: the best reaches the threshold and every other is below it. One pass of aggregates, no
    window: a group of any size is merged by partial results.
    """
    best = F.max_by(F.col(order), F.struct(F.col(score), -F.col(order)))
    g = candidates.groupBy(*group).agg(best.alias("pick"), F.max(score).alias("best"), F.count("*").alias("n"), F.count_if(F.col(score) >= threshold).alias("reach"))
    return g.select(*group, "pick", "best", "n", ((F.col("best") >= threshold) & (F.col("reach") == 1)).alias("confident"))


def equal_within(x: Column, y: Column, tolerance: float = 0.0, numeric: bool = True) -> Column:
    """Null-safe equality; numbers may differ by the tolerance."""
    same = x.eqNullSafe(y)
    return same | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if numeric and tolerance > 0 else same


def table_diff(a: DataFrame, b: DataFrame, key: str, tolerance: float = 0.0, stems: list[str] | None = None) -> DataFrame:
    """key, status (only_a, only_b, changed) and the changed columns, of rows that differ.

    Columns in `stems` are compared by their file stems.
    """
    from loomwork.functions.columns import file_stem

    columns = [c for c in a.columns if c != key]
    numbers = {f.name for f in a.schema if f.dataType.typeName() in ("integer", "long", "float", "double", "short", "byte") or "decimal" in f.dataType.typeName()}
    x = a.select(F.col(key), F.struct(F.lit(1).alias("is_"), *columns).alias("a_"))
    y = b.select(F.col(key), F.struct(F.lit(1).alias("is_"), *columns).alias("b_"))
    j = x.join(y, key, "full_outer")

    def side(s: str, c: str) -> Column:
        v = F.col(f"{s}_")[c]
        return file_stem(v) if c in (stems or []) else v

    changed = F.filter(F.array(*[F.when(~equal_within(side("a", c), side("b", c), tolerance, c in numbers), F.lit(c)) for c in columns]), lambda v: v.isNotNull())
    status = F.when(F.col("b_").isNull(), "only_a").when(F.col("a_").isNull(), "only_b").when(F.size(changed) > 0, "changed")
    return j.select(key, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).otherwise("").alias("columns")).where("status IS NOT NULL")


def pool_overlaps(pools: DataFrame, pool: str, item: str) -> DataFrame:
    """pool_a, pool_b, n: shared items of every two pools that share any.

    Items meet on their key; the pools of one item (a few) make its pairs.
    """
    g = pools.select(pool, item).distinct().groupBy(item).agg(F.array_sort(F.collect_list(pool)).alias("p"))
    pairs = g.where(F.size("p") > 1).select(F.explode(F.expr("flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> struct(x AS pool_a, y AS pool_b))))")).alias("q"))
    return pairs.groupBy("q.pool_a", "q.pool_b").agg(F.count("*").alias("n"))


def pool_counts(pools: DataFrame, pool: str, item: str) -> DataFrame:
    """Rows, distinct items and duplicates of each pool."""
    g = pools.groupBy(pool).agg(F.count("*").alias("n_rows"), F.count_distinct(item).alias("n_distinct"))
    return g.withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def seeded_pick(matches: DataFrame, group: list[str], item: str, seed: int) -> DataFrame:
    """Of each group the item with the smallest SHA-256 of seed, group and item: uniform and repeatable."""
    h = F.sha2(F.concat_ws("/", F.lit(str(seed)), *[F.col(g).cast("string") for g in group], F.col(item).cast("string")).cast("binary"), 256)
    return matches.groupBy(*group).agg(F.min_by(F.col(item), h).alias(item), F.count("*").alias("n_matches"))


def range_pick(items: DataFrame, pool: DataFrame, item_key: str, low: str, high: str, pool_key: str, value: str, width: float, seed: int) -> DataFrame:
    """For each item one pool entry, picked by hash, among those with low <= value <= high.

    Instead of a nested loop over all pairs, values are cut into bins of `width` and items into the
    bins that their range covers; equal bins meet in a hash join and the inequality is checked there.
    """
    bins = items.withColumn("bin_", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    own = pool.withColumn("bin_", F.floor(F.col(value) / width).cast("long"))
    m = bins.join(own, "bin_").where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high)))
    return seeded_pick(m.select(item_key, pool_key), [item_key], pool_key, seed)


def pool_slice(items: DataFrame, key: str, seed: int, first: int, last: int) -> DataFrame:
    """Rows first to last - 1 of a seeded permutation: slices of one permutation never overlap."""
    h = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"), 256)
    return numbered(items.withColumn("h_", h), ["h_", key], "rn_").where((F.col("rn_") > first) & (F.col("rn_") <= last)).drop("h_", "rn_").orderBy(key)


def shuffle_plan(items: DataFrame, key: str, seed: int) -> DataFrame:
    """Each item with the item that takes its place in a seeded permutation."""
    a = numbered(items.select(key), [key], "rn")
    b = numbered(items.select(F.col(key).alias("partner"), uniform(F.lit(seed), key).alias("u_")), ["u_", "partner"], "rn")
    return a.join(b.select("rn", "partner"), "rn").select(key, "partner")


def strided_shard(items: DataFrame, key: str, seed: int, enlarge: int, shards: int, shard: int) -> DataFrame:
    """A shard of a seeded permutation that is repeated `enlarge` times: position, key."""
    n = items.count()
    p = numbered(items.select(key, uniform(F.lit(seed), key).alias("u_")), ["u_", key], "rn_")
    p = p.withColumn("position", F.explode(F.transform(F.sequence(F.lit(0), F.lit(enlarge - 1)), lambda e: e * n + F.col("rn_") - 1)))
    return p.where(F.pmod("position", F.lit(shards)) == shard).select("position", key)


def surfaces_with_positions(surfaces: DataFrame, asphere: DataFrame, group: str) -> DataFrame:
    """Surfaces left-joined to their aspheric terms, with z: the distances of the surfaces before, but the first's."""
    w = Window.partitionBy(group).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(group).orderBy("i"))
    s = surfaces.withColumn("step_", F.when(first == 1, 0.0).otherwise(F.coalesce("D", F.lit(0.0))))
    s = s.withColumn("z", F.coalesce(F.sum("step_").over(w), F.lit(0.0))).drop("step_")
    return s.join(asphere.hint("merge"), [group, "i"], "left")


def copy_matching(new: DataFrame, old: DataFrame, on: list[str], value: str, order: str) -> DataFrame:
    """`new` with the value of the last old row of equal keys, 0 without one."""
    last = old.groupBy(*on).agg(F.max_by(value, order).alias(value))
    return new.join(last, on, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def dependency_levels(nodes: DataFrame, edges: DataFrame, node: str, needs: str) -> DataFrame:
    """node, level: 0 without needs, else one more than the highest level needed; null for nodes on or behind a cycle.

    Edges are rows (node, needs); nodes that only edges name count too, repeated edges count once. Each
    round takes the nodes whose open needs have come down to none: the edges that lead out of the last
    round's nodes are counted and taken off, so an edge is counted in one round only. Rounds are as many
    as levels; their tables are written to the shared folder.
    """
    e = stored(edges.select(F.col(node).alias("node"), F.col(needs).alias("needs")).where("node IS NOT NULL AND needs IS NOT NULL").distinct(), "levels-edges")
    every = nodes.select(F.col(node).alias("node")).where("node IS NOT NULL").unionByName(e.select("node")).unionByName(e.select(F.col("needs").alias("node"))).distinct()
    wait = every.join(e.groupBy("node").agg(F.count("*").alias("open")), "node", "left").select("node", F.coalesce("open", F.lit(0)).cast("long").alias("open"), F.lit(None).cast("int").alias("level"))
    level = 0
    while True:
        wait = stored(wait.withColumn("level", F.when(F.col("level").isNull() & (F.col("open") == 0), level).otherwise(F.col("level"))), "levels")
        last = wait.where(F.col("level") == level).select(F.col("node").alias("needs"))
        if last.isEmpty():
            return wait.select(F.col("node").alias(node), "level")
        down = e.join(last, "needs", "left_semi").groupBy(F.col("node").alias("d_node")).agg(F.count("*").alias("down"))
        wait = wait.join(down, F.col("node") == F.col("d_node"), "left").select("node", (F.col("open") - F.coalesce("down", F.lit(0))).alias("open"), "level")
        level += 1


def dependency_order(levels: DataFrame, node: str) -> DataFrame:
    """The nodes in an order in which needs come first: by level, then by node. Nodes of a cycle raise when evaluated."""
    message = F.concat(F.lit("cycle at or before node "), F.col(node).cast("string"))
    return levels.where(F.when(F.col("level").isNull(), F.raise_error(message).cast("boolean")).otherwise(True)).orderBy("level", node)


def folder_key(path: str | Column, up: int = 1) -> Column:
    """The name of the folder `up` levels above a file."""
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1 - up)


def stem_key(path: str | Column, drop: int = 0, lead: str = "") -> Column:
    """A file's name without its extension, `drop` leading characters replaced by `lead`."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.concat(F.lit(lead), F.substring(F.regexp_replace(name, r"\.[^.]*$", ""), drop + 1, 1 << 30))


def derived_pairs(low: DataFrame, high: DataFrame, path: str, low_key: Column, high_key: Column) -> DataFrame:
    """key, low, high, status of files paired by keys made from their paths: paired, no_high or no_low.

    Any number of low files may share a high one and the other way round (each low file with each high
    file of its key); a path that gives no key stays alone. Rows in the order of the key are left to the caller.
    """
    a = low.select(low_key.alias("a_key"), F.col(path).alias("low")).where("low IS NOT NULL")
    b = high.select(high_key.alias("b_key"), F.col(path).alias("high")).where("high IS NOT NULL")
    # a left join and an anti join in place of a full one: a key with very many files can then be split over tasks
    pairs = a.join(b, F.col("a_key") == F.col("b_key"), "left").select(F.col("a_key").alias("key"), "low", "high", F.when(F.col("high").isNull(), "no_high").otherwise("paired").alias("status"))
    alone = b.join(a.select("a_key").distinct(), F.col("a_key") == F.col("b_key"), "left_anti")
    return pairs.unionByName(alone.select(F.col("b_key").alias("key"), F.lit(None).cast("string").alias("low"), "high", F.lit("no_low").alias("status")))


def pair_completeness(pairs: DataFrame) -> DataFrame:
    """One row: paired, low and high files with a partner, files of either side without one, and whether all have one."""
    paired = F.col("status") == "paired"
    g = pairs.groupBy("key", "status").agg(F.count_distinct("low").alias("lows"), F.count_distinct("high").alias("highs"), F.count("*").alias("n"))
    s = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    out = g.agg(s("n", paired).alias("paired"), s("lows", paired).alias("low_paired"), s("highs", paired).alias("high_paired"), s("lows", ~paired).alias("low_alone"), s("highs", ~paired).alias("high_alone"))
    return out.withColumn("complete", (F.col("low_alone") == 0) & (F.col("high_alone") == 0))


def assignment_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, status (missing, added, changed), old, new as text: one row for each assignment that differs.

    A key that only one side has gives a row for each column, with null on the other side.
    """
    x = a.select(F.col(key), F.lit(True).alias("in_a_"), *[F.col(c).cast("string").alias(f"a_{c}_") for c in columns])
    y = b.select(F.col(key), F.lit(True).alias("in_b_"), *[F.col(c).cast("string").alias(f"b_{c}_") for c in columns])
    j = x.join(y, key, "full_outer")
    status = F.when(F.col("in_a_").isNull(), "added").when(F.col("in_b_").isNull(), "missing").otherwise("changed")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}_").alias("old"), F.col(f"b_{c}_").alias("new")) for c in columns])
    d = j.select(key, status.alias("status"), F.explode(cells).alias("c_")).where("status <> 'changed' OR NOT (c_.old <=> c_.new)")
    return d.select(key, "c_.column", "status", "c_.old", "c_.new")


def resolved_names(df: DataFrame, given: str, known: DataFrame, name: str, target: str, out: str) -> DataFrame:
    """`df` with the target of a known name; a given path (with a slash) stands for itself, an unknown name is null."""
    k = known.groupBy(F.col(name).alias("k_")).agg(F.min(target).alias("t_"))
    j = df.join(k, F.col(given) == F.col("k_"), "left")
    return j.withColumn(out, F.when(F.col(given).contains("/"), F.col(given)).otherwise(F.col("t_"))).drop("k_", "t_")
