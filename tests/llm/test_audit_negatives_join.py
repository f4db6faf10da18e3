"""Operators 11 to 13 against plain versions."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import filter_audit, hard_negatives, jaccard_join
from tests.llm import brute
from tests.llm.test_operators import CLASHES, PAIRS, ROWS, SCHEMA

MORE = ["bucket", "label_", "q", "w", "block", "norm", "longest", "A", "E", "good", "part", "words_", "digest", "place", "c", "n", "id", "k", "token", "df", "first_id", "l", "f", "t"]
VECTORS = "vec_id long, embedding array<float>, label int"


def plain_audit(docs, labels):
    """part, order, step -> counts, by applying every order to all documents."""
    marks = collections.defaultdict(lambda: [False, False])
    for i, q, t in labels:
        if i is not None:
            marks[i] = [marks[i][0] or q == 1, marks[i][1] or t == 1]
    judged = []
    for i, text, lang in docs:
        text = text or ""
        w = brute.WORD.findall(text)
        smaller = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}
        judged.append((lang or "", {x for x, bad in fails.items() if bad}, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        removed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [j for j in left if x in j[1]]
                left = [j for j in left if x not in j[1]]
                removed[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(x in j[1] for j in own) - len(gone), sum(j[1] == {x} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed[order[k - 1]])
    return out


def test_audit(spark):
    rows = [r[:3] for r in ROWS if len(r[1] or "") < 30_000] + [(None, "to be or not", None), (7, "to be or not", "en"), (7, "to be or not", "en"), (5_001, "A$ " * 9_000, ""), (5_002, "A$ " * 9_000, "xx")]
    labels = [(i, k % 2, k % 3 % 2) for k, (i, *_) in enumerate(rows) if k % 4] + [(7, 0, 1), (7, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, None, 0) for r in rows], SCHEMA).withColumns({c: F.lit("clash") for c in MORE})
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, table).collect()}
    want = plain_audit(rows, labels)
    assert len(got) == 600 * len({p for p, *_ in want}) and got == want


def test_audit_of_nothing(spark):
    empty = filter_audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.collect() == [] and empty.columns[:3] == ["part", "filter_order", "step"]


def plain_negatives(rows):
    """All output rows, from all scores, as a multiset; rows are (vec_id, embedding, label)."""
    good = []
    for k, (i, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        good.append((i, [max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(x))))) for x in e], label, k))
    out = collections.Counter()
    for a in good:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[1], c[1], strict=False)), c[0] is None, c[0] or 0, c[2]) for c in good if c is not a))
        for s, none, i, _ in [x for x in scored if x[3] == a[2]][:5]:
            fits = [(x[0], None if x[1] else x[2]) for x in scored if x[3] != a[2] and 30 * -s <= 100 * -x[0] <= 90 * -s]
            for r, (score, j) in enumerate(fits[:10]):
                out[a[0], None if none else i, r + 1, j, -s, -score] += 1
    return out


def vectors(n, width, seed, lengths=(1.0,)):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rnd.gauss(0.1, 0.5) * rnd.choice(lengths) for _ in range(width)]
        rows.append((k * 20, v, rnd.randrange(3)))
    return rows


@pytest.mark.parametrize("size,block", [(1024, 256), (8, 2)])
def test_negatives(spark, size, block):
    rows = vectors(150, 6, 1, (0.2, 1.0, 3.0))
    rows += [(5_000, rows[3][1], 1), (5_001, rows[3][1], 2), (5_002, rows[3][1], 2), (5_003, rows[5][1][:3], 1), (5_100, [], 1), (5_104, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0], 2)]
    rows += [(None, rows[0][1], 1), (None, rows[1][1], None), (6_000, None, 1), (6_100, [1.0, None], 1), (6_200, [float("nan")] * 6, 1), (6_300, [float("inf")] * 6, 0), rows[5], rows[5]]
    d = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit("clash") for c in MORE})
    got = collections.Counter(tuple(r) for r in hard_negatives.mined(d, size, block).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_negatives(rows) and len(got) > 100


def test_negatives_prune_by_length(spark):
    """Short rows can't reach the limits of long anchors: their buckets aren't asked, and nothing is lost."""
    rows = vectors(60, 4, 2) + [(10_001 + k, [0.01] * 4, k % 3) for k in range(400)]
    got = collections.Counter(tuple(r) for r in hard_negatives.mined(spark.createDataFrame(rows, VECTORS), 16, 4).collect())
    assert got == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    for rows in ([], [(100, None, 1)], [(100, [1.0], 1)], [(1, [1.0], 1), (2, [2.0], 1)]):
        assert hard_negatives.mined(spark.createDataFrame(rows, VECTORS)).collect() == []


def plain_join(rows):
    """doc_id -> (size, component), from all pairs; rows are (doc_id, text) with different doc_ids."""
    sets = {}
    for i, t in rows:
        w = brute.WORD.findall((t or "").translate(brute.LOWER))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(seed, n, words, most):
    """Variants of one text, each with up to `most` words changed, in runs and alone."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        at = rnd.randrange(words)
        for j in range(rnd.randint(0, most)):
            w[(at + j * rnd.choice((1, 7))) % words] = f"x{k}y{j}"
        out.append(" ".join(w[: words - rnd.randint(0, 6)]))
    return out


@pytest.mark.parametrize("rounds", [0, 6])
def test_join(spark, rounds, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RANGE", 700)
    monkeypatch.setattr(jaccard_join, "SLICE", 3_000)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    texts = family(1, 80, 90, 7) + family(2, 40, 300, 20) + family(3, 30, 12, 1) + ["a b", "A  b", "b a", "", None, " \n", "long word " * 3_000, "a b c " * 20_000 + "d", "a b c d " * 9]
    rows = [*PAIRS, *((10_000 + k, t) for k, t in enumerate(texts))]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in {x.lower() for x in [*CLASHES, *MORE]}})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(d, rounds).collect()}
    want = plain_join(rows)
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 50


def test_join_rows(spark):
    """Repeated rows, rows without doc_id, an empty table."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (5, text), (None, text), (9, text + " end"), (None, "alone here now"), (None, None), (5, "another text here"), (12, "no partner at all")]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in jaccard_join.joined(d).collect()), key=str)
    want = [(5, 38, 5), (5, 38, 5), (None, 38, 5), (9, 39, 5), (None, 1, None), (None, 0, None), (5, 1, 5), (12, 2, 12)]
    assert got == sorted(want, key=str)
    assert jaccard_join.joined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_join_asks_few(spark):
    """A large group of near copies that aren't linked gives few candidates: rare tokens come first."""
    texts = [" ".join(f"x{k}y{j}" if j % 9 == k % 9 else f"w{j}" for j in range(120)) for k in range(300)]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "place long, doc_id long, text string")
    shared = jaccard_join.shared_tokens(rows.select("place", "text"), jaccard_join.text_sets, 300 * 118)
    assert shared.where("k >= 107").count() == 0
