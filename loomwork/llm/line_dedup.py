"""Operator 3: line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are the \\n-split parts of a text that hold a word. Equal lines are one content, first seen at
the smallest (doc_id, line number). Two contents are linked if both have MIN_CHARS characters or more
and they are within EDITS edits of each other, so at most a twelfth of a line differs:

- A content is split into EDITS + 1 segments. Of two linked contents, at least one segment of the
  shorter stands unchanged in the longer one, near its own place. Index rows are the segments by
  length, number and characters; probe rows are the substrings of a content at the few places where
  a segment of a content up to EDITS shorter can stand. They meet in an equi-join on a hash.
- A segment that more than COMMON contents share is common: many variants of one line would meet each
  other there. What is left of them beside that segment is cut again, and again while more than
  SPLIT * COMMON contents share a key: with at most two edits in one part its first third, its last
  third or (one edit before, one after) its middle is equal; with one edit in a part either of its halves
  is. Keys are chained hashes of the parts that are equal, so contents of a key are equal in all but what
  is left. Two contents are found under the first of these choices that holds for them: a row holds what
  must differ, and a key where that is the same in all contents is given up. What all contents of a key
  have in common is cut off in one row, so a template with a number stays one row for each key until
  the number is reached. No link is lost: each choice covers the pairs that the choices before it do not.
  What is left of two contents that meet is compared at once, and only near ones are candidates.
- Candidates are verified by a bit-parallel edit distance on the band of 2 * EDITS + 1 diagonals:
  one bit mask for each number of edits says which diagonals are reached, and a row of the table is
  a few shifts. Common starts and ends are cut off first, by bisection.

A line stays if it is the first of its content and no linked content was seen earlier. A line that
occurs in very many documents is merged by partial counts before the shuffle and is one row after.

Edge cases: null or empty texts and lines without words have no part in this (such lines stay where
the text is rebuilt); rows of one doc_id are one document, of which a line stays where its first place
and content are met again; rows without a doc_id count as one document after all others; an empty
table gives none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import fresh, written

EDITS, MIN_CHARS = 2, 24
#: Contents that share a segment before it is common; what is left of them is cut further where more than SPLIT times as many share a key.
COMMON, SPLIT = 4, 4
#: Contents or keys up to this number are sent to all tasks (a few numbers each); more are shuffled.
BROADCAST_ROWS = 1_000_000
_SHIFT, _LAST = "2147483648BD", "9223372036854775808BD"  # stands for a null doc_id


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of every line with a word."""
    d = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def contents(lines: DataFrame) -> DataFrame:
    """lid, line, doc_id, line_no (first seen) and n_chars of each different line, written once."""
    place = F.expr(f"coalesce(cast(doc_id AS decimal(20, 0)), {_LAST}) * {_SHIFT} + line_no")
    c = lines.groupBy("line").agg(F.min(place).alias("place"))
    c = c.withColumn("line_no", F.expr(f"cast(pmod(place, {_SHIFT}) AS int)"))
    c = c.withColumn("doc_id", F.expr(f"if(place >= {_LAST} * {_SHIFT}, null, cast((least(place, {_LAST} * {_SHIFT} - 1) - line_no) div {_SHIFT} AS bigint))"))
    return written(c.select(F.monotonically_increasing_id().alias("lid"), "line", "doc_id", "line_no", F.length("line").alias("n_chars")), "line-contents")


def _segment(n: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (0-based) and length of segment `i` of a line of `n` characters; the last ones are longer."""
    k = edits + 1
    base, longer = F.floor(n / k).cast("int"), n % k
    return base * i + F.greatest(F.lit(0), i - (k - longer)), base + (F.lit(i) >= k - longer).cast("int")


def _key(i: int, n: Column, start: Column, length: Column) -> Column:
    return F.xxhash64(F.lit(i), n, F.col("line").substr(start + 1, length))


def index_keys(edits: int = EDITS) -> Column:
    """The keys of the segments of a content."""
    n = F.col("n_chars")
    return F.array(*[_key(i, n, *_segment(n, i, edits)) for i in range(edits + 1)])


def probe_keys(edits: int = EDITS) -> Column:
    """The keys of the substrings of a content where a segment of an up to `edits` shorter one can stand (null: nowhere).

    Segment i of the shorter can have moved by at most i edits before it, and by the difference of
    lengths less the edits that are left after it.
    """
    keys = []
    for less in range(edits + 1):
        n = F.col("n_chars") - less
        for i in range(edits + 1):
            start, length = _segment(n, i, edits)
            for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                at = start + move
                keys.append(F.when((at >= 0) & (at + length <= F.col("n_chars")), _key(i, n, at, length)))
    return F.array(*keys)


#: Of a key's kind: the segment that is equal, how much longer the probing content is, and by how much the segment has moved.
_PLACES = {"index": [(i, 0, 0) for i in range(3)], "probe": [(i, less, m) for less in range(3) for i, moves in ((0, [0]), (1, range(max(-1, less - 1), min(1, less + 1) + 1)), (2, [less])) for m in moves]}
_STATE = ["key", "lid", "probe", "w1", "d1", "w2", "d2", "ml", "mr"]


def _opened(rows: DataFrame, side: str) -> DataFrame:
    """What is left of the contents with a common segment: key, lid, probe, w1, d1, w2, d2, ml, mr (see `_cut`).

    `rows`: key, at (the key's position in its array), lid, line, n_chars.
    """
    places = ", ".join(f"struct({i} AS i, {less} AS less, {m} AS move)" for i, less, m in _PLACES[side])
    d = rows.withColumn("x", F.expr(f"array({places})[at]")).withColumn("n", F.expr("n_chars - x.less"))
    (_, first), (start, mid), (_, last) = (_segment(F.col("n"), i, EDITS) for i in range(3))
    d = d.select("key", "lid", "line", "n_chars", "x", first.cast("int").alias("first"), start.cast("int").alias("start"), mid.cast("int").alias("mid"), last.cast("int").alias("last"))
    return d.selectExpr(
        "key", "lid", f"{side == 'probe'} AS probe",
        "CASE x.i WHEN 0 THEN substring(line, first + 1) WHEN 1 THEN left(line, start + x.move) ELSE left(line, n_chars - last) END AS w1",
        "if(x.i = 1, x.move, x.less) AS d1",
        "if(x.i = 1, substring(line, start + x.move + mid + 1), null) AS w2",
        "if(x.i = 1, x.less - x.move, 0) AS d2",
        "if(x.i = 0, lid, xxhash64(left(line, first))) AS ml",
        "if(x.i = 1, xxhash64(right(line, last)), lid) AS mr",
    )


#: Whether a part of what is left stands in all contents of a key: first and last part of w1, first and last of w2.
_UNIFORM = {
    "u1": "if(w2 IS NULL, left(w1, (length(w1) - d1) div 3), left(w1, (length(w1) - d1) div 2))",
    "u2": "if(w2 IS NULL, right(w1, (length(w1) - d1) div 3), right(w1, length(w1) - d1 - (length(w1) - d1) div 2))",
    "u3": "left(w2, (length(w2) - d2) div 2)",
    "u4": "right(w2, length(w2) - d2 - (length(w2) - d2) div 2)",
}
#: Nothing is left to cut: two characters of the shorter content, or one on either side.
_DONE = "if(w2 IS NULL, length(w1) - d1 < 3, length(w1) - d1 < 2 AND length(w2) - d2 < 2)"


def _cut(state: DataFrame) -> DataFrame:
    """The next cut of what is left, one row for each part that may be equal.

    w1 alone: at most two edits in it; w1 and w2: one in either. d1, d2: by how much the content's own part is
    longer than that of the shorter content. ml, mr: what differs in the pairs that are found here; a pair that
    is equal in it is found under another key. u1 to u4: see `_UNIFORM`; what all have is cut off, nothing else.
    """
    whole = "cast(null AS string) AS w2, 0 AS d2"
    one = [f"struct(xxhash64(key, 0, left(w1, a)) AS key, substring(w1, a + 1) AS w1, d1, {whole}, ml, mr, u1 OR NOT u2 AS has)"]
    one.append(f"struct(xxhash64(key, 2, right(w1, a)) AS key, left(w1, length(w1) - a) AS w1, d1, {whole}, if(u2, ml, xxhash64(left(w1, a))) AS ml, mr, NOT u1 AS has)")
    for m in (-1, 0, 1):
        one.append(f"""struct(xxhash64(key, 1, substring(w1, a + {m} + 1, length(w1) - d1 - 2 * a)) AS key, left(w1, a + {m}) AS w1, {m} AS d1, right(w1, a + d1 - {m}) AS w2,
            d1 - {m} AS d2, xxhash64(left(w1, a)) AS ml, xxhash64(right(w1, a)) AS mr, NOT u1 AND NOT u2 AND abs(d1 - {m}) <= 1 AND (probe OR {m} = 0) AS has)""")
    half = lambda w, h, d, must, first, last: f"""if(length({w}) - {d} > 1,
        filter(array(struct(0 AS side, left({w}, {h}) AS part, substring({w}, {h} + 1) AS w, {must} AS must, {first} OR NOT {last} AS has),
            struct(1 AS side, right({w}, length({w}) - {d} - {h}) AS part, left({w}, {d} + {h}) AS w, if({last}, {must}, xxhash64(left({w}, {h}))) AS must, NOT {first} AS has)), x -> x.has),
        array(struct(2 AS side, '' AS part, {w} AS w, {must} AS must, true AS has)))"""  # noqa: E731
    both = f"""flatten(transform({half("w1", "b", "d1", "ml", "u1", "u2")}, l -> transform({half("w2", "c", "d2", "mr", "u3", "u4")},
        r -> struct(xxhash64(key, l.side, l.part, r.side, r.part) AS key, l.w AS w1, d1, r.w AS w2, d2, l.must AS ml, r.must AS mr))))"""
    a = state.where("w2 IS NULL").withColumn("a", F.expr("(length(w1) - d1) div 3").cast("int"))
    a = a.selectExpr("lid", "probe", f"inline(filter(array({', '.join(one)}), x -> x.has))")
    b = state.where("w2 IS NOT NULL").withColumns({"b": F.expr("(length(w1) - d1) div 2").cast("int"), "c": F.expr("(length(w2) - d2) div 2").cast("int")})
    return a.select(_STATE).unionByName(b.selectExpr("lid", "probe", f"inline({both})").select(_STATE))


def refined_pairs(state: DataFrame, common: int = COMMON) -> DataFrame:
    """a, b: contents (index, probe) that are near in what is left, cut further wherever many share a key."""
    found, same = [], [F.expr(f"coalesce(min(xxhash64({part})) = max(xxhash64({part})), false) AS {u}") for u, part in _UNIFORM.items()]
    while True:
        state = written(state, "line-state")
        hot = state.groupBy("key").agg(F.count_if(~F.col("probe")).alias("n"), F.bool_or(F.expr(_DONE)).alias("done"), F.expr("min(ml) < max(ml) AND min(mr) < max(mr)").alias("open"), *same)
        hot = written(hot.where(F.col("n") > SPLIT * common).where("NOT (done AND open)").select(F.col("key").alias("k"), "open", *_UNIFORM), "line-common")
        n, n_open = hot.agg(F.count("*"), F.count_if("open")).first()
        keys = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        found.append(state.join(keys.select("k"), F.col("key") == F.col("k"), "left_anti"))
        if not n_open:
            break
        state = _cut(state.join(keys.where("open"), F.col("key") == F.col("k")))
    rows = reduce(DataFrame.unionByName, found)
    i, p = (rows.where("NOT probe" if x == "a" else "probe").select([F.col(c).alias(f"{c}_{x}") for c in _STATE]) for x in "ab")
    own = F.expr("key_a = key_b AND (lid_a < lid_b OR lid_a <> lid_b AND d1_b + d2_b > 0) AND ml_a <> ml_b AND mr_a <> mr_b")
    near = F.expr("levenshtein(w1_a, w1_b, if(w2_a IS NULL, 2, 1)) >= 0 AND (w2_a IS NULL OR levenshtein(w2_a, w2_b, 1) >= 0)")
    return i.join(p, own & near).select(F.col("lid_a").alias("a"), F.col("lid_b").alias("b")).distinct()


def _common(a: str, b: str, side: str) -> Column:
    """The length of the common start (left) or end (right) of two strings, by bisection."""
    part = (lambda c, k: F.left(F.col(c), k)) if side == "left" else (lambda c, k: F.right(F.col(c), k))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    short = F.least(F.length(a), F.length(b))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= short) & (part(a, n + s) == part(b, n + s)), n + s).otherwise(n))


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _settled(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns that later steps see as values: the optimiser does not copy their expressions into lambdas."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def within_edits(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether the edit distance of arrays of characters `a` and `b` (columns) is at most `edits`.

    Row i stands after i characters of `b`; bit k + edits of mask e says that the cell on diagonal k
    (i + k characters of `a`) is reached by at most e edits.
    """
    width = 2 * edits + 1
    every = (1 << width) - 1
    start = F.struct(*[F.lit(sum(1 << (k + edits) for k in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)])

    def masks(s: Column, same: Column, done: list[Column]) -> Column:
        """The new state: mask e from the old masks e and e - 1 and the new mask e - 1."""
        e = len(done)
        if e > edits:
            return F.struct(*[m.alias(f"r{k}") for k, m in enumerate(done)])
        m = s[f"r{e}"].bitwiseAND(same)
        if e:
            old = s[f"r{e - 1}"]
            m = m.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(done[-1], 1))
        return _let(m.bitwiseAND(F.lit(every)), lambda v: masks(s, same, [*done, v]))

    def row(s: Column, i: Column) -> Column:
        own = F.get(F.col(b), i - 1)
        same = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.get(F.col(a), i - 1 + k) == own, 1 << (k + edits)).otherwise(0) for k in range(-edits, edits + 1)])
        return F.when(s[f"r{edits}"] == 0, s).otherwise(_let(same, lambda v: masks(s, v, [])))

    rows = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.expr("cast(array() AS array<int>)"))
    gap = F.size(a) - F.size(b)
    return F.aggregate(rows, start, row, lambda s: F.when(F.abs(gap) > edits, False).otherwise(F.pmod(F.floor(s[f"r{edits}"] / F.pow(F.lit(2), gap + edits)), F.lit(2)) == 1))


def verified(pairs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The pairs (a, b with line_a, line_b) within `edits` edits."""
    p = _settled(pairs, ["a", "b", "line_a", "line_b"], cut=_common("line_a", "line_b", "left"))
    p = _settled(p.select("a", "b", F.col("line_a").alias("full_a"), F.col("line_b").alias("full_b"), "cut"), ["a", "b"], line_a=F.expr("substring(full_a, cut + 1)"), line_b=F.expr("substring(full_b, cut + 1)"))
    p = _settled(p, ["a", "b", "line_a", "line_b"], cut=_common("line_a", "line_b", "right"))
    chars = lambda c: F.expr(f"filter(split(left({c}, length({c}) - cut), ''), x -> x <> '')")
    p = _settled(p, ["a", "b"], chars_a=chars("line_a"), chars_b=chars("line_b"))
    return p.where(within_edits("chars_a", "chars_b", edits)).select("a", "b")


def _few(ids: DataFrame) -> DataFrame:
    """A table of a few numbers a row, broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(ids) if len(ids.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n")).where(F.col("n") <= BROADCAST_ROWS).take(1)) else ids


def candidates(c: DataFrame, edits: int = EDITS, common: int = COMMON) -> DataFrame:
    """a, b (lids): every two contents that may be linked, written once."""
    keys = written(c.select("lid", index_keys(edits).alias("index"), probe_keys(edits).alias("probe")), "line-keys")
    i, p = keys.select(F.explode("index").alias("key"), "lid"), keys.select(F.explode("probe").alias("key"), "lid").where("key IS NOT NULL")
    hot = i.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > common).select(F.col("key").alias("k"))
    if edits != EDITS:  # the finer cut is made for this number of edits
        hot = hot.limit(0)
    hot = _few(written(hot, "line-common"))
    a, b = i.withColumnRenamed("lid", "a"), p.withColumnRenamed("lid", "b")
    rare = a.join(hot, F.col("key") == F.col("k"), "left_anti").join(b, "key").where("a <> b").select("a", "b").distinct()
    if not hot.take(1):
        return written(rare, "line-pairs")
    sides = []
    for side in ("index", "probe"):
        rows = keys.select(F.posexplode(side).alias("at", "key"), "lid").join(hot, F.col("key") == F.col("k"), "left_semi")
        ids = _few(written(rows, f"line-{side}"))
        sides.append(_opened(c.select(F.col("lid").alias("own"), "line", "n_chars").join(ids, F.col("lid") == F.col("own")), side))
    return written(rare.unionByName(refined_pairs(sides[0].unionByName(sides[1]), common)).distinct(), "line-pairs")


def links(c: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """a, b (lids) of linked contents; b is the longer, or the larger id of two of equal length."""
    pairs = candidates(c.where(F.col("n_chars") >= min_chars), edits, common)
    ids = _few(written(pairs.select(F.col("a").alias("own")).unionByName(pairs.select(F.col("b").alias("own"))).distinct(), "line-ids"))
    text = written(c.select("lid", "line", "n_chars").join(ids, F.col("lid") == F.col("own"), "left_semi"), "line-candidates")
    p = pairs.join(text.select(F.col("lid").alias("a"), F.col("line").alias("line_a"), F.col("n_chars").alias("n_a")), "a")
    p = p.join(text.select(F.col("lid").alias("b"), F.col("line").alias("line_b"), F.col("n_chars").alias("n_b")), "b")
    return written(verified(p.where("n_a < n_b OR (n_a = n_b AND a < b)"), edits), "line-links")


def decisions(docs: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Contents with near (an earlier content is linked) and n_links, and the links."""
    c = contents(document_lines(docs))
    found = links(c, edits)
    place = c.select("lid", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no").alias("at"))
    both = found.join(place.select(F.col("lid").alias("a"), F.col("at").alias("at_a")), "a").join(place.select(F.col("lid").alias("b"), F.col("at").alias("at_b")), "b")
    sides = both.select(F.col("a").alias("l"), (F.col("at_b") < F.col("at_a")).alias("late")).unionByName(both.select(F.col("b").alias("l"), (F.col("at_a") < F.col("at_b")).alias("late")))
    sides = sides.groupBy("l").agg(F.count("*").alias("links"), F.bool_or("late").alias("late"))
    c = c.select("lid", "doc_id", "line_no", F.sha2(F.col("line").cast("binary"), 256).alias("sha"), F.xxhash64("line").alias("content"))
    out = c.join(sides, F.col("lid") == F.col("l"), "left")
    return out.select("lid", "doc_id", "line_no", "sha", "content", F.coalesce("late", F.lit(False)).alias("near"), F.coalesce("links", F.lit(0)).alias("n_links")), found


def line_report(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_copies, n_near, n_links, kept_sha256 of every row.

    n_copies: lines that stand earlier already; n_near: first lines that an earlier content is linked
    with; kept_sha256: the digest of the digests of the lines that stay, in order.
    """
    d = docs.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"))
    lines, _ = decisions(docs, edits)
    by = lines.groupBy(F.col("doc_id").alias("first_doc")).agg(
        F.count("*").alias("n_first"),
        F.count_if("near").alias("n_near"),
        F.sum("n_links").alias("n_links"),
        F.array_sort(F.collect_list(F.when(~F.col("near"), F.struct("line_no", "sha")))).alias("stay"),
    )
    d = d.join(by, F.col("doc_id").eqNullSafe(F.col("first_doc")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    kept = F.sha2(F.coalesce(F.array_join(F.transform("stay", lambda s: s["sha"]), ""), F.lit("")).cast("binary"), 256)
    return d.select("doc_id", "n_lines", (F.col("n_lines") - zero("n_first")).alias("n_copies"), zero("n_near").alias("n_near"), zero("n_links").alias("n_links"), kept.alias("kept_sha256"))


def drop_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents, with the columns of the input, without copied and near-copied lines."""
    lines, _ = decisions(docs, edits)
    first, stay = fresh(docs, "first_doc_"), fresh(docs, "stay_")
    own = lines.where("NOT near").groupBy(F.col("doc_id").alias(first)).agg(F.collect_set(F.struct("line_no", "content")).alias(stay))
    d = docs.join(own, F.col("doc_id").eqNullSafe(F.col(first)), "left")
    stays = lambda x, i: F.coalesce(F.array_contains(stay, F.struct(i.alias("line_no"), F.xxhash64(x).alias("content"))), F.lit(False))
    keeps = F.filter(F.split("text", "\n"), lambda x, i: ~x.rlike(r"[^\x20\x09-\x0D]") | stays(x, i))
    return d.withColumn("text", F.array_join(keeps, "\n")).select(*[f"`{c}`" for c in docs.columns])
