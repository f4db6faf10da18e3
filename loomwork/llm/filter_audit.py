"""Operator 12: what quality filters remove in every order, by depth-first execution of a permutation trie.

Every document is judged once by every filter; the verdicts are written. A node of the trie is the set
of filters applied so far. Its survivors are a persisted DataFrame, made by applying one more filter to
its parent's survivors; orders that begin with the same filters in another sequence share the node, so
31 nodes serve all 120 orders. At each node the removals of every filter that may follow (the node's
outgoing edges) are counted among its survivors, by part, and written; then the walk goes on depth
first and lets go of the survivors when all nodes below are done, so at most five are held at once. A
lost executor costs only the survivors that it held, which are filtered anew from the written verdicts.

The report is put together from the edges: what a filter removes at a step is the edge from the set of
the filters before it; its Shapley sum weighs each edge by the number of orders that pass through it.

Edge cases: a null text is empty, a null lang is the part ''; a row without doc_id is no copy of any
other and has no labels; rows repeated with one doc_id are documents of their own, none of them a copy
of the other (no smaller doc_id); of several labels of one doc_id any 1 counts; an empty table gives no
parts and so no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import written

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Fewest words; fewest distinct words and most capitals in percent; symbols that aren't allowed.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, r"[#$%&*|]"


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (true: the document fails the filter), good, toxic of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    n_words, n_distinct = F.size("words"), F.size(F.array_distinct("words"))
    d = d.select(
        "doc_id",
        "part",
        (n_words < MIN_WORDS).alias("A"),
        (100 * n_distinct < MIN_DISTINCT * n_words).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS * F.length("text")).alias("C"),
        F.col("text").rlike(SYMBOLS).alias("D"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    d = written(d, "audit-verdicts")
    # the first row of each text is found by its own doc_id, so a text with very many copies is no hot key
    first = d.where("doc_id IS NOT NULL").groupBy(F.col("digest").alias("f_digest")).agg(F.min("doc_id").alias("f_id"))
    d = d.join(first, (F.col("doc_id") == F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left")
    d = d.withColumn("E", F.col("doc_id").isNotNull() & F.col("f_id").isNull())
    marks = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    d = d.join(marks, F.col("doc_id") == F.col("l_id"), "left")
    return d.select("part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def edges(verdict: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, state, n, filter, removed, good, toxic: of every node's n survivors, what each further filter removes.

    `state` has the letters of the filters applied, in the order of `filters`; parts without survivors have no row.
    """
    done: dict[str, DataFrame] = {}

    def visit(state: str, survivors: DataFrame) -> None:
        rest = [f for f in filters if f not in state]
        if not rest:
            return
        survivors = survivors.persist()
        out = [F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic")) for f in rest]
        counts = survivors.groupBy("part").agg(F.count("*").alias("n"), F.array(*out).alias("out"))
        done[state] = written(counts.select("part", F.lit(state).alias("state"), "n", F.inline("out")), f"audit-edges{state}")
        for f in rest:
            child = "".join(x for x in filters if x in state or x == f)
            if child not in done:
                visit(child, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit("", written(verdict, "audit-facts"))
    first, *more = done.values()
    for x in more:
        first = first.unionByName(x)
    return first


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for all parts, orders and steps."""
    found = edges(verdicts(docs, labels))
    weights = [(s, f, math.factorial(len(s)) * math.factorial(len(FILTERS) - 1 - len(s))) for f in FILTERS for s in _states() if f not in s]
    grid = F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("weight")) for s, f, w in weights]))
    parts = found.where("state = '' AND filter = 'A'")
    whole = parts.select("part", grid).join(found, ["part", "state", "filter"], "left").na.fill(0, ["n", "removed", "good", "toxic"])
    whole = written(whole, "audit-whole")
    alone = F.max(F.when(F.length("state") == len(FILTERS) - 1, F.col("removed"))).alias("unique_fails")
    sums = whole.groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"), alone, F.max(F.when(F.col("state") == "", F.col("removed"))).alias("fails"))
    steps = [(o, k + 1, "".join(sorted(o[:k])), f) for o in ORDERS for k, f in enumerate(o)]
    walk = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state string, filter string")
    out = whole.join(sums, ["part", "filter"]).join(F.broadcast(walk), ["state", "filter"])  # 600 rows
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def _states() -> list[str]:
    return sorted({"".join(sorted(o[:k])) for o in ORDERS for k in range(len(FILTERS))}, key=lambda s: (len(s), s))


ORACLE = r"""
    WITH marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    texts AS (
        SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS s, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
               list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
    ),
    judged AS (
        SELECT part, good, toxic,
               CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
               || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
               || CASE WHEN 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 3 * length(s) THEN 'C' ELSE '' END
               || CASE WHEN regexp_matches(s, '[#$%&*|]') THEN 'D' ELSE '' END
               || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY s) THEN 'E' ELSE '' END AS fails
        FROM texts
    ),
    kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ),
    steps AS (SELECT o, k, substr(o, k, 1) AS f, left(o, k - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
    counted AS (
        SELECT part, o, k, f,
               sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
        FROM kinds, steps GROUP BY part, o, k, f
    )
    SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM counted
"""
