"""Operator 1: personal data by patterns and by bootstrapped context, in DataFrame functions only.

Base spans come from four patterns. Then the method:

1. Identifier-like tokens (words with a digit or an @) of all texts are instances; the whole word before
   and the whole word after an instance are its lexical patterns. The edges of the pattern-instance
   graph are the different (pattern, instance) pairs of the whole table.
2. Instances that hold a base span are seeds of its kind. Each round scores a pattern by the share of
   its instances (plus SMOOTHING) that are known to be of the kind, accepts it at PATTERN_SCORE with
   at least LEAST_SEEDS known instances, then scores an unknown instance by the mean of its patterns'
   scores over all its patterns, and accepts it at INSTANCE_SCORE if its letters and digits suit the
   kind. Accepted instances are known in the next round; rounds end when one accepts nothing.
3. Wherever an accepted instance stands, it is a span of its kind, unless it meets a base span.

All scores are grouped sums over edges; nothing is gathered on the driver. Accepted patterns and
instances are few as a rule: up to FEW rows they are sent to all tasks, more are shuffled.

Offsets of a regular expression's matches: the text is cut by one expression into (gap, match) pairs,
up to the end, and the lengths in code points are summed up by doubling, in log(matches) passes over
the array. The gap is lazy and each expression can start a match only where a run of its characters
begins. A token's neighbours are read from the gaps beside it, and whether a base span meets it from a
bisection, all before tokens become rows; so the time is near linear in one text, however many it holds.

Edge cases: a null or empty text has no spans; repeated rows are searched each, and a null doc_id is
reported as any other; an empty table gives none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
PATTERN_SCORE, INSTANCE_SCORE, LEAST_SEEDS, SMOOTHING = 0.5, 0.5, 3, 2.0
#: Accepted patterns or instances that are broadcast at most.
FEW = 50_000

# Matches as the contract's patterns give them. Possessive runs and the conditions on what stands
# before do not change a match: a run that fails at its first character fails at the others too.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that this does not find has no match; most texts end here.
_HINTS = {"email": "@[A-Za-z0-9-]+[.]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _pieces(text: str, pattern: str) -> tuple[Column, Column]:
    """The gaps before all matches and the matches; a last gap stands before an empty match at the text's end."""
    cut = F.lit(rf"(?s)(.*?)({pattern}|\z)")
    return F.regexp_extract_all(text, cut, F.lit(1)), F.regexp_extract_all(text, cut, F.lit(2))


def running(x: Column) -> Column:
    """The sums of an array of numbers up to each place: log(size) passes, each adding what stands further left."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(x))
    return F.aggregate(steps, x, lambda a, s: F.transform(a, lambda v, i: F.when(i >= s, v + F.get(a, i - s)).otherwise(v)))


def matches(d: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """`d` with arrays {name}_gaps, {name}_hits and {name}_ends: of each gap and match the place after it, in code points."""
    gaps, hits = _pieces(text, pattern)
    d = d.withColumns({f"{name}_gaps": gaps, f"{name}_hits": hits})
    lengths = F.zip_with(f"{name}_gaps", f"{name}_hits", lambda g, h: F.length(g) + F.length(h))
    return d.withColumn(f"{name}_ends", running(lengths))


def luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


_NONE = "cast(array() AS array<struct<start:int,finish:int>>)"


def base_spans(docs: DataFrame) -> DataFrame:
    """The columns of `docs` (with text_), and for each kind an array of struct(start, finish), in order."""
    d = docs
    for kind in KINDS:
        hinted = F.col("text_").rlike(_HINTS[kind])
        gaps, hits = f"{kind}_gaps", f"{kind}_hits"
        d = d.withColumn("own_", F.when(hinted, F.col("text_")).otherwise(""))
        d = matches(d, "own_", _PATTERNS[kind], kind)
        at = F.filter(F.transform(hits, lambda h, i: i), lambda i: (F.get(hits, i) != "") & _valid(kind, F.get(hits, i)))
        end = lambda i: F.get(f"{kind}_ends", i)  # noqa: B023, E731
        spans = F.transform(at, lambda i: F.struct((end(i) - F.length(F.get(hits, i))).alias("start"), end(i).alias("finish")))
        d = d.withColumn(kind, F.when(F.size(hits) > 1, spans).otherwise(F.expr(_NONE))).drop("own_", gaps, hits, f"{kind}_ends")
    return d


def _joined(column: str, kind: str) -> Column:
    return F.transform(F.array_sort(column), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["finish"].cast("string")))


def _suits(kind: str, token: Column) -> Column:
    """Whether an instance's characters can be of the kind at all."""
    n = F.length(F.regexp_replace(token, "[^0-9]", ""))
    return {"email": token.contains("@"), "ip": (n >= 4) & token.rlike(r"[0-9][.:,][0-9]"), "card": n.between(12, 19), "phone": n.between(7, 15)}[kind]


def _met(kind: str, start: Column, finish: Column) -> Column:
    """Whether a span of the kind meets start to finish: the last one that starts before `finish`, by bisection."""
    n = F.size(kind)
    steps = F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(31))]), lambda s: s <= n)
    before = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= n) & (F.get(kind, p + s - 1)["start"] < finish), p + s).otherwise(p))
    return F.when(n == 0, F.lit(False)).otherwise(F.coalesce(F.get(kind, before - 1)["finish"] > start, F.lit(False)))


def occurrences(found: DataFrame) -> DataFrame:
    """row_, token, start, finish, before, after (neighbouring words) and kind (of a base span inside, or null)."""
    d = matches(found.where(F.col("text_").rlike("[0-9@]")).select("row_", "text_", *KINDS), "text_", _TOKEN, "t").drop("text_")
    spaces = lambda c: F.translate(c, "\t\n\x0b\x0c\r", "     ")
    last, first = (lambda g: F.substring_index(F.rtrim(spaces(g)), " ", -1)), (lambda g: F.substring_index(F.ltrim(spaces(g)), " ", 1))
    d = d.withColumn("t_left", F.transform("t_gaps", last)).withColumn("t_right", F.transform("t_gaps", first)).drop("t_gaps")
    own = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))

    def token(h: Column, i: Column) -> Column:
        finish = F.get("t_ends", i)
        start = finish - F.length(h)
        kind = reduce(lambda a, k: F.when(_met(k, start, finish), F.lit(k)).otherwise(a), reversed(KINDS), F.lit(None).cast("string"))
        before = F.when(own("t_left", i) != "", own("t_left", i)).otherwise(own("t_hits", i - 1))
        after = F.when(own("t_right", i + 1) != "", own("t_right", i + 1)).otherwise(own("t_hits", i + 1))
        return F.struct(h.alias("hit"), start.alias("start"), finish.alias("finish"), F.lower(before).alias("before"), F.lower(after).alias("after"), kind.alias("kind"))

    d = d.select("row_", F.explode(F.filter(F.transform("t_hits", token), lambda t: t["hit"] != "")).alias("t"))
    return d.select("row_", F.regexp_replace("t.hit", r"(?<![.,;:!?)\]\"'#*$%&|<>])[.,;:!?)\]\"'#*$%&|<>]++$", "").alias("token"), "t.start", "t.finish", "t.before", "t.after", "t.kind")


def _few(d: DataFrame) -> DataFrame:
    """A written table, broadcast if it has at most FEW rows."""
    return F.broadcast(d) if len(d.take(FEW + 1)) <= FEW else d


def bootstrap(seen: DataFrame) -> DataFrame:
    """token, kind of the unknown instances that the rounds accept, until a round accepts none."""
    sides = [seen.select("token", "kind", F.concat(F.lit(s + " "), c).alias("pattern")).where(F.col(c) != "") for s, c in (("<", "before"), (">", "after"))]
    edges = written(sides[0].unionByName(sides[1]).groupBy("pattern", "token").agg(F.min("kind").alias("kind")), "pii-edges")
    seeds = seen.where("kind IS NOT NULL").groupBy("token").agg(F.min("kind").alias("k_kind"))
    # an instance is of one kind wherever it stands
    marked = written(edges.select("pattern", "token").join(seeds.withColumnRenamed("token", "k_token"), F.col("token") == F.col("k_token"), "left").drop("k_token"), "pii-marked")
    accepted, turn = None, 0
    while True:
        total = marked.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("k_kind") == x).alias(x) for x in KINDS])
        score = lambda x: F.when(F.col(x) >= LEAST_SEEDS, F.col(x) / (F.col("n") + SMOOTHING)).otherwise(0.0)
        scores = total.select(F.col("pattern").alias("p"), *[F.when(score(x) >= PATTERN_SCORE, score(x)).otherwise(0.0).alias(x) for x in KINDS])
        scores = written(scores.where(F.greatest(*KINDS) > 0), f"pii-scores{turn}")
        open_ = marked.where("k_kind IS NULL").select("pattern", "token").join(_few(scores), F.col("pattern") == F.col("p"), "left")
        means = open_.groupBy("token").agg(*[F.avg(F.coalesce(x, F.lit(0.0))).alias(x) for x in KINDS])
        best = F.greatest(*[F.struct(F.when(_suits(x, F.col("token")), F.col(x)).otherwise(0.0).alias("s"), F.lit(x).alias("k")) for x in KINDS])
        new = written(means.select("token", best.alias("b")).where(F.col("b.s") >= INSTANCE_SCORE).select("token", F.col("b.k").alias("kind")), f"pii-new{turn}")
        accepted = new if accepted is None else accepted.unionByName(new)
        if new.isEmpty():
            return accepted
        late = _few(new.select(F.col("token").alias("n_token"), F.col("kind").alias("n_kind")))
        marked = written(marked.join(late, F.col("token") == F.col("n_token"), "left").select("pattern", "token", F.coalesce("k_kind", "n_kind").alias("k_kind")), "pii-marked")
        turn += 1


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans, of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text_"))
    found = base_spans(d)
    # only rows with a digit or an @ can hold a span; their text is needed once more, for the contexts
    found = found.withColumn("row_", F.monotonically_increasing_id())
    found = written(found.withColumn("text_", F.when(F.col("text_").rlike("[0-9@]"), F.col("text_")).otherwise("")), "pii-base")
    seen = written(occurrences(found), "pii-tokens")
    new = written(bootstrap(seen), "pii-known").select(F.col("token").alias("a_token"), F.col("kind").alias("a_kind"))
    added = seen.where("kind IS NULL").join(_few(new), F.col("token") == F.col("a_token"))
    added = added.groupBy(F.col("row_").alias("a_row")).agg(F.collect_list(F.struct("a_kind", "start", F.col("start").cast("int") + F.length("token"))).alias("more"))
    d = found.drop("text_").join(added, F.col("row_") == F.col("a_row"), "left")
    base = F.concat(*[_joined(k, k) for k in KINDS])
    everything = F.concat(*[_joined_with(k) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(everything, ",").alias("spans"))


def _joined_with(kind: str) -> Column:
    """Base and added spans of one kind, by start."""
    own = F.col(kind)
    more = F.coalesce(F.transform(F.filter("more", lambda s: s["a_kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["col3"].alias("finish"))), F.expr(_NONE))
    return F.transform(F.array_sort(F.concat(own, more)), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["finish"].cast("string")))
