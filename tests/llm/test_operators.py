"""Each operator against its plain version, on texts with every edge case at once."""

import collections
import math
import os
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from loomwork.llm import bloom_lm, byte_bpe, exact_dedup, line_dedup, near_dedup, pii_bootstrap, quality_rules, source_mix, toxicity, warc_derivatives
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the input.
CLASHES = ["size", "kept", "keep_id", "h", "n", "cls", "comp", "key", "set", "sig", "line", "lid", "words", "row", "part", "seq", "text_", "score_", "target", "taken", "g", "spans", "place", "rank", "a", "b", "row_", "stays_", "own_", "times_", "copy_", "first_doc_", "stay_", "keep_id_", "doc_id_", "main", "slot", "chars_", "first", "last"]


def make_rows():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 7))) for _ in range(150)] + ["the", "of", "and", "für", "año", "été"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [text(rnd.choice((3, 20, 60, 120))) for _ in range(60)]
    base = [text(20) for _ in range(6)]
    for k in range(24):  # near copies: words changed, each a little differently
        w = " ".join(base).split()
        for _ in range(k % 5):
            w[rnd.randrange(len(w))] = f"w{k}"
        texts.append("\n".join(" ".join(w[i : i + 20]) for i in range(0, len(w), 20)))
    line = "this is a line that occurs again and again in texts"
    texts += [f"{line}\n{text(30)}\n{line}" for _ in range(5)] + [line.replace("again and", "agan  and") + "\n" + line.replace("texts", "textes") + "\nshort\nshort"]
    texts += ["mail a.b+c@x-y.example.com_d@e.f.org, 10.0.0.255 999.1.1.1 1.2.3.4.5 +1 (917) 555-7017 4111 1111 1111 1111 4111111111111112 é a@b", "+12345678 0012.0.0.1 4111-1111-1111-1111-x", "@ @ . 1.1.1.1"]
    texts += [None, "", " \n\t ", "\n", "x", "A a a A", "a" * 20_000, "word " * 4_000, "the of and " * 60, "ÀÉ 日本 語 x y \U0001f600 \x1c\x85"]
    texts += ["to be  or\tnot", "to be or not", "to be or\n\nnot "] + [base[0]] * 7
    rows = [(3 * k + 1, t, rnd.choice(("en", "de", None)), rnd.choice(("s0", "s0", "s1", "s2", None)), 0) for k, t in enumerate(texts)]
    return rows


ROWS = make_rows()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return d.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def repeated(spark):
    """Two rows given twice, and a null text."""
    return spark.createDataFrame([ROWS[0], ROWS[0], ROWS[61], ROWS[61], (9_999, None, None, None, 0)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_pii(docs):
    got = {r.doc_id: r for r in pii_bootstrap.spans(docs).collect()}
    for i, t in PAIRS:
        out, n = brute.pii(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n, (i, t)
        assert r.base_sha256 == brute.sha(",".join(out)) and set(out) <= set(r.spans.split(","))
    assert len(got) == len(PAIRS)


def test_pii_learns_from_context(spark):
    """`mail` and `wrote` stand around addresses; one that the pattern does not know is found by them."""
    texts = [f"please mail user{k}@host{k}.example.org wrote back" for k in range(12)] + ["please mail someone@localhost wrote back", "code 77x88 here"]
    d = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in pii_bootstrap.spans(d).collect()}
    assert got[12].n_email == 0 and got[12].spans == "email:12:29" and texts[12][12:29] == "someone@localhost"
    assert got[13].spans == "" and got[0].spans == "email:12:35"


def test_bpe(docs):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(byte_bpe.read_ranks(RANKS))}, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    for i, t in PAIRS:
        if len(t or "") < 20_000:  # the library takes long for one long word
            ids = library.encode_ordinary(t or "")
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), brute.sha(",".join(map(str, ids)))), t
        assert got[i].decoded_sha256 == brute.sha(t or "")
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {i: (t or "").encode() for i, t in PAIRS}


def test_bpe_out_of_order_ranks():
    """A rank table in which a merge makes a pair of a lower rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"zz", b"zzz"]
    replay = byte_bpe.MergeReplay(tokens)
    pieces = [b"abc", b"xabcabc", b"ab", b"zzzzz", b"zzzz", b"", b"q"]
    one = lambda p: byte_bpe.unpacked(replay._one_by_one(p))
    want = [[256], one(b"xabcabc"), [257], one(b"zzzzz"), one(b"zzzz"), [], [ord("q")]]
    assert [byte_bpe.unpacked(p) for p in replay.encode(pieces)] == want


def test_lines(docs):
    got = sorted(tuple(r) for r in line_dedup.line_report(docs).collect())
    assert got == sorted(brute.lines(PAIRS))


def test_lines_of_one_family(spark):
    """Many variants of one line, so that all its segments are common; some are within two edits of others."""
    rnd = random.Random(3)
    base = [rnd.choice("abcdefgh ") for _ in range(70)]
    texts = []
    for k in range(140):
        line = list(base)
        for _ in range(rnd.choice((1, 1, 2, 5))):
            at = rnd.randrange(len(line))
            line[at : at + rnd.randint(0, 1)] = [rnd.choice("abcXY")] * rnd.randint(0, 1)
        texts.append((k, "".join(line) + ("\n" + "".join(base[k % 9 :]) if k % 5 == 0 else "")))
    texts.append((None, "".join(base) + "\nof no document, but a line of its own in it"))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((tuple(r) for r in line_dedup.line_report(d).collect()), key=str)
    assert got == sorted(brute.lines(texts), key=str)
    c = line_dedup.contents(line_dedup.document_lines(d))
    found = [{tuple(sorted((r.a, r.b))) for r in line_dedup.links(c, common=n).collect()} for n in (0, 8, 10_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 300


def test_lines_of_one_template(spark):
    """Lines that differ in a number only: beside the links, only pairs of rare segments become candidates."""
    rnd = random.Random(1)
    texts = [(k, f"The quick report number {rnd.randrange(10**6):06d} was written for the board of the cömpany today") for k in range(400)]
    texts += [(k + 400, t.replace("quick", "quíck") if k % 2 else t[:-1]) for k, (_, t) in enumerate(texts[:40])]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute.lines(texts)
    assert sorted(tuple(r) for r in line_dedup.line_report(d).collect()) == want
    pairs = line_dedup.candidates(line_dedup.contents(line_dedup.document_lines(d))).count()
    assert sum(r[4] for r in want) // 2 <= pairs <= sum(r[4] for r in want) + line_dedup.COMMON * len(texts)


def test_edit_distance(spark):
    rnd = random.Random(2)
    pairs = []
    for k in range(300):
        a = [rnd.choice("abé") for _ in range(rnd.randint(0, 12))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 1)] = [rnd.choice("abc")] * rnd.randint(0, 1)
        pairs.append((k, -k, "".join(a), "".join(b)))
    d = spark.createDataFrame(pairs, "a long, b long, line_a string, line_b string")
    got = {r.a for r in line_dedup.verified(d).collect()}
    assert got == {k for k, _, a, b in pairs if brute.edit_distance(a, b) <= 2}


def test_lines_are_dropped(spark):
    d = spark.createDataFrame([(1, "a line of more than twenty-four characters\n\nx", "en", "s", 0), (2, "a line of more then twenty-four characters\ny", "en", "s", 0)], SCHEMA)
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(d).collect()} == {1: "a line of more than twenty-four characters\n\nx", 2: "y"}


def test_quality(docs):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t in PAIRS:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), t
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(docs):
    """Distances and verdicts against the plain version."""
    want = brute.quality_verdicts([(i, t, lang) for i, t, lang, _, _ in ROWS], quality_rules)
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, (c, w, kept) in want.items():
        r = got[i]
        assert (r.character_distance is None) == (c is None) and (r.word_distance is None) == (w is None), i
        assert c is None or r.character_distance == pytest.approx(c, abs=1e-9)
        assert w is None or r.word_distance == pytest.approx(w, abs=1e-9)
        assert r.kept == kept, i
    assert any(c is not None for c, _, _ in want.values()) and any(w is not None for _, w, _ in want.values())


def test_quality_rejects_strange_texts(spark):
    rnd = random.Random(1)
    words = ["the", "of", "and", "to", *("".join(rnd.choice("aeinrst") for _ in range(6)) for _ in range(300))]
    texts = [" ".join(rnd.choice(words[:4] if rnd.random() < 0.3 else words) for _ in range(150)) for _ in range(40)]
    texts.append(" ".join("".join(rnd.choice("#$%&*0123456789") for _ in range(6)) for _ in range(150)))
    d = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.kept for r in quality_rules.judged(d).collect()}
    assert not got.pop(40) and all(got.values())


def test_quality_rejects_by_common_words(spark):
    """A text in the wrong language and one without common words, of the same letters as the others."""
    rnd = random.Random(2)
    content = ["".join(rnd.choice("aeinrst") for _ in range(6)) for _ in range(300)]
    text = lambda usual, n: " ".join(rnd.choice(usual if rnd.random() < 0.12 else content) for _ in range(n))
    english, german = ["the", "of", "and", "to"], ["der", "die", "und", "den"]
    rows = [(k, text(english, 80 + 10 * k), "en") for k in range(40)] + [(100 + k, text(german, 80 + 10 * k), "de") for k in range(40)]
    rows += [(200 + k, text(content, 80 + 10 * k), "la") for k in range(10)]  # a language without any of COMMON
    strange = [(300, text(content, 100), "en"), (301, text(content, 400), "de"), (302, text(german, 400), "en"), (303, text(english, 400), "de")]
    d = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows + strange], SCHEMA)
    got = {r.doc_id: r.kept for r in quality_rules.judged(d).collect()}
    assert [got.pop(k) for k in range(300, 304)] == [False] * 4 and all(got.values())


def test_lm(docs):
    got = {r.doc_id: r for r in bloom_lm.scores(docs).collect()}
    for i, held, n, known, total, base in brute.lm_base(PAIRS):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    rest = [got[i] for i, t in PAIRS if got[i].held_out]
    assert sum(r.score for r in rest) > 1.3 * sum(r.base_score for r in rest)


def test_lm_scores(docs):
    """The model's scores against exact counts; a false hit of the filter may move a few of them."""
    want = brute.lm_scores(PAIRS, bloom_lm.RATIO, bloom_lm.MIX)
    got = {r.doc_id: r.score for r in bloom_lm.scores(docs).collect()}
    same = sum(got[i] == pytest.approx(v, rel=1e-6) for i, v in want.items())
    assert same >= 0.9 * len(want) and all(got[i] == pytest.approx(v, rel=0.02) for i, v in want.items())


def test_lm_filter_counts():
    import numpy as np

    rng = np.random.default_rng(0)
    g = rng.integers(0, 1 << 62, 2_000).astype(np.uint64)
    n = np.exp(rng.uniform(0, 9, 2_000))
    bits = np.zeros((bloom_lm.SEGMENTS, bloom_lm.SEGMENT_BITS // 8), np.uint8)
    f = bloom_lm.LogFrequencyFilter(bits, 1.0)
    level = 1 + np.floor(np.log(n) / np.log(bloom_lm.RATIO)).astype(int)
    for s in range(bloom_lm.SEGMENTS):
        own = np.zeros(bloom_lm.SEGMENT_BITS, bool)
        for j in range(1, level.max() + 1):
            for p in f.places(g[(f.segment(g) == s) & (level >= j)], j):
                own[p] = True
        bits[s] = np.packbits(own, bitorder="little")
    got = f.count(g)
    assert (got <= n * 1.0001).all() and (got * bloom_lm.RATIO >= n * 0.9999).all()
    assert (f.count(rng.integers(0, 1 << 62, 5_000).astype(np.uint64)) == 0).mean() > 0.999


def test_lm_keeps_rare_grams_of_large_inputs(spark):
    """With over 2**22 training tokens, pairs and words that occur once still count in the score."""
    train = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = [k for k in range(200) if k not in train]
    rows = [(k, "a " * 120_000) for k in train[:40]]
    rows += [(train[40], "p q r s"), (train[41], "p a q"), (held[0], "p q r s"), (held[1], "s r q p")]
    got = {r.doc_id: r for r in bloom_lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = 40 * 120_001 + 9
    whole, m = n + 7, bloom_lm.MIX  # 6 different tokens, the end included
    count = {"p": 2, "q": 2, "r": 1, "s": 1, "a": 4_800_001, "end": 42}
    level = lambda c: bloom_lm.RATIO ** math.floor(math.log(c) / math.log(bloom_lm.RATIO)) if c else 0.0
    own = lambda h, w, c: math.log10(m * min(level(c) / count[h], 1.0) + (1 - m) * (count[w] + 1) / whole)
    want = own("end", "p", 2) + own("p", "q", 1) + own("q", "r", 1) + own("r", "s", 1) + own("s", "end", 1)
    assert got[held[0]].train_tokens == n and got[held[0]].score == pytest.approx(want, rel=1e-9)
    assert got[held[1]].base_score == pytest.approx(got[held[0]].base_score) and got[held[1]].score < got[held[0]].score - 5


def test_near(docs):
    got = sorted(tuple(r) for r in near_dedup.near_groups(docs).collect())
    assert got == sorted(brute.near(PAIRS))


def test_near_family(spark):
    """A family in which most pairs are no links: chains and strays that only the blocks compare."""
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 7)):
            w[rnd.randrange(len(w))] = f"x{k}_{rnd.randrange(9)}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_groups(d, rounds=1).collect())
    assert got == sorted(brute.near(rows))


def test_near_pairs_are_compared_once():
    """A pivot in another component than its block's name, and a block with many survivors (matrix product)."""
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(1, 3_000, 80).astype(np.uint64)) for _ in range(60)]
    x, y = (a.ravel() for a in np.meshgrid(np.arange(60), np.arange(60)))
    want = [len(set(sets[u].tolist()) & set(sets[v].tolist())) for u, v in zip(x, y, strict=True)]
    assert len(x) > near_dedup.MANY and near_dedup._common(sets, x, y).tolist() == want
    assert near_dedup._common(sets, x[:50], y[:50]).tolist() == want[:50]


def test_near_due_pairs():
    """A pair is due once: in the block of its first common key, and only if neither has met the other."""
    import numpy as np

    rnd = random.Random(3)
    keys = {c: sorted(rnd.sample(range(40), rnd.randint(1, 6))) for c in range(50)}
    mains = {k: k % 3 for k in range(40)}
    met = {c: rnd.sample(range(50), rnd.randint(0, 3)) for c in keys}
    seen = []
    for main in (0, 1, 2):
        inside = [c for c in keys if any(mains[k] == main for k in keys[c])]
        row = np.array([True] * len(inside) + [False] * len(inside))
        c = np.array(inside * 2)
        flat = lambda f: tuple(np.array(x, np.int64) for x in zip(*[(v, i) for i, d in enumerate(inside * 2) for v in f(d)], strict=True))  # noqa: B023, E731
        due = near_dedup.due_pairs(row, c, flat(lambda d: [k for k in keys[d] if mains[k] == main]), flat(lambda d: [k for k in keys[d] if mains[k] != main]), flat(lambda d: met[d]))  # noqa: B023
        seen += [(inside[x], inside[y]) for x, y in zip(*np.nonzero(due), strict=True) if inside[x] < inside[y]]
    want = [(x, y) for x in keys for y in keys if x < y and set(keys[x]) & set(keys[y]) and y not in met[x] and x not in met[y]]
    assert sorted(seen) == want and want


def test_near_family_meets_in_buckets_only(spark):
    """Families without links: no pair is compared twice, nor one that shares no bucket."""
    import numpy as np

    rnd = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(200):
        w = list(base)
        for at in rnd.sample(range(120), rnd.randint(4, 9)):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "row long, text string").selectExpr("row", "row AS place", "row AS doc_id", "text")
    nodes = near_dedup.fingerprints(d).selectExpr("row AS c", "cast(n_shingles AS int) AS n", "sig")
    members = near_dedup.buckets(nodes).withColumn("comp", F.col("c"))
    asked = near_dedup.pivot_pairs(members, 0).select("q", "c")
    met = {frozenset(r) for r in asked.collect()}
    by_key = {}
    for r in members.collect():
        by_key.setdefault(r.key, set()).add(r.c)
    want = {frozenset((x, y)) for g in by_key.values() for x in g for y in g if x < y} - met
    blocks = near_dedup.stray_blocks(members, asked).toPandas()
    got = []
    for _, b in blocks.groupby(["main", "i", "j"]):
        flat = lambda name: tuple(np.array(z, np.int64) for z in [[(v, i)[side] for i, x in enumerate(b[name]) if x is not None for v in x] for side in (0, 1)])  # noqa: B023, E731
        row, c, twice = (b[k].to_numpy() for k in ("row", "c", "twice"))
        due = near_dedup.due_pairs(row, c, flat("own"), flat("others"), flat("met"))
        for x, y in zip(*np.nonzero(due), strict=True):
            u, v = np.flatnonzero(row)[x], np.flatnonzero(~row)[y]
            if c[u] != c[v] and not (twice[v] and c[v] < c[u]):
                got.append(frozenset((int(c[u]), int(c[v]))))
    assert len(got) == len(set(got)) and set(got) == want


def test_near_rows_without_doc_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(None, a), (4, a + " x"), (3, a), (None, b), (None, b + " y"), (None, None), (9, None), (7, "u v w x y z"), (7, "p q r s t u")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(d).collect()), key=str)
    want = [(None, 56, 3, False), (4, 57, 3, False), (3, 56, 3, True), (None, 56, None, None), (None, 57, None, None), (None, 0, None, None), (9, 0, 9, True), (7, 2, 7, True), (7, 2, 7, True)]
    assert got == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_copies(d).collect()), key=str)
    assert len(kept) == 6 and (3, a) in kept and sum(t in (b, b + " y") for _, t in kept) == 1


def test_near_pruning_bounds():
    least = [near_dedup.fewest_matches(n) for n in (32, 64, 128)]
    assert least == sorted(least) and 0 < least[0] < 24 and 60 < least[2] < 96


def test_exact(docs):
    want = sorted(brute.exact(PAIRS))
    assert sorted(tuple(r) for r in exact_dedup.exact_groups(docs).collect()) == want
    # a table of a few bytes: many levels of partitions, the same result
    assert sorted(tuple(r) for r in exact_dedup.exact_groups(docs, table_bytes=9_000).collect()) == want


def test_drop_copies_decides_by_row(spark):
    """Rows of one doc_id with different texts, and rows without a doc_id."""
    rows = [(1, "A"), (2, "A"), (2, "B"), (None, "A"), (None, "C"), (None, "C"), (None, "D"), (3, "D"), (4, "E"), (4, "E")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted([(1, "A"), (2, "B"), (None, "C"), (3, "D"), (4, "E")], key=str)
    for table_bytes in (exact_dedup.TABLE_BYTES, 200):
        assert sorted(map(tuple, exact_dedup.drop_copies(d, table_bytes).collect()), key=str) == want
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(d).collect()}
    assert got == {(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, None), (2, 2, 1, True), (None, None, 2, None), (3, 3, 2, True), (None, 3, 2, None), (4, 4, 2, True)}


def test_content_table_compares_contents():
    t = exact_dedup.ContentTable(1 << 20)
    for k in range(5_000):
        content = str(k).encode()
        e, slot = t.find(k % 7, content)
        assert e < 0
        t.add(slot, k % 7, content)
    assert all(t.find(k % 7, str(k).encode())[0] == k for k in range(5_000))


def test_mix(docs):
    block = 8
    got = {r.doc_id: r for r in source_mix.mix(docs, block=block).collect()}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    want, targets, size, slots = brute.mixed([(i, t, s) for i, t, _, s, _ in ROWS], order, block)
    assert len(got) == len(ROWS)
    taken = collections.Counter()
    for i, t, _, s, _ in ROWS:
        r = got[i]
        assert (r["size"], r.source_size) == (len(brute.WORD.findall(t or "")), size[s]) and r.target == pytest.approx(targets[s])
        assert (r.taken, r.first_slot, r.last_slot) == want[i] and r.taken <= 2 * r["size"], i
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 3 * block for s in size)
    for k in range(len(slots)):  # every prefix holds each source in its share, to within a few blocks
        if k % 50 == 0:
            n = collections.Counter(slots[:k])
            assert all(abs(n[s] - k * targets[s] / sum(targets.values())) < 4 for s in size)
    again = {r.doc_id: (r.taken, r.first_slot) for r in source_mix.mix(docs.repartition(7), block=block).collect()}
    assert again == {i: (r.taken, r.first_slot) for i, r in got.items()}


def test_mixed_documents(docs):
    """Each document as often as half of it or more is taken."""
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    copies = brute.mixed_copies([(i, t, s) for i, t, _, s, _ in ROWS], order, source_mix.BLOCK)
    got = source_mix.mixed_documents(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r.doc_id for r in got.select("doc_id").collect()) == +copies


def toxic_rows():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for k in range(420):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        bad = k % 4 == 0
        for _ in range(3 if bad else 0):
            w[rnd.randrange(len(w))] = "grumpf" + rnd.choice(("", "en", "ist", "ly", "ab", "ox"))
        rows.append((k, " ".join(w), "en", "s", 0))
        marks.append((k, 1, int(bad)))
    return rows, marks


def test_toxicity(spark):
    rows, marks = toxic_rows()
    rows += [(1_000, None, None, None, 0), (1_001, "", "en", "s", 0), (1_002, "## !!", "en", "s", 0), (1_003, "plain " * 3_000, "en", "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("score_x", F.lit(1)).withColumn("toxic", F.lit(0))
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels(spark, [*marks, (5_000, 0, 1), (2, None, None)])).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[k].predicted, y) for k, _, y in marks if got[k].held_out]
    assert len(held) > 60 and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in marks)


def test_toxicity_scores():
    """Scores against the network's definition, window by window and unit by unit."""
    import numpy as np

    rows, marks = toxic_rows()
    net = toxicity.train([r[1].encode() for r in rows[:80]], np.array([m[2] for m in marks[:80]]), steps=20)
    texts = [rows[0][1], rows[7][1], "one", "", "## !", "word " * 70]
    data = [t.encode() for t in texts]
    words = toxicity.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]).astype(np.int64))
    got = toxicity.text_logits(net, words)
    plain = {k: np.asarray(v, dtype=float).tolist() for k, v in net.p.items()}
    x, at = net.inputs(words).astype(float).tolist(), 0
    for k, n in enumerate(words.counts.tolist()):
        vectors = [x[w] for w in words.which[at : at + n].tolist()]
        at += n
        starts = sorted({*range(0, max(n - toxicity.WINDOW, 0), toxicity.STRIDE), max(n - toxicity.WINDOW, 0)})
        want = max(brute.gru_logit(plain, vectors[s : s + toxicity.WINDOW]) for s in starts) + net.shift
        assert got[k] == pytest.approx(want, abs=1e-3), texts[k]


def test_toxicity_gradients():
    """The written gradients agree with differences of the loss."""
    import numpy as np

    texts = [b"one two three", b"bad words here and some more words to fill the window", b"x"]
    words = toxicity.Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]).astype(np.int64))
    net = toxicity.Network(np.sort(words.hash[:4]))
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    _, start, length = words.windows()
    tokens, target = toxicity._tokens(words, start, length), np.array([0.0, 1.0, 0.0])

    def loss():
        z = net.forward(net.inputs(words).astype(np.float64) @ net.p["W"] + net.p["b"], tokens)
        return float(np.mean(np.logaddexp(0, np.where(target > 0, -z, z))))

    grads = net.gradients(words, net.inputs(words), tokens, target)
    for k, g in grads.items():
        if isinstance(g, tuple):
            full = np.zeros_like(net.p[k])
            np.add.at(full, g[0], g[1])
            g = full
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = net.p[k][at], 1e-2
        net.p[k][at] = old + step
        up = loss()
        net.p[k][at] = old - step
        down = loss()
        net.p[k][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=2e-4), k


def test_warc(spark, tmp_path):
    html = "<html><head><title>A &amp; B</title><style>x</style></head><body><p>One<br>two &lt;3</p><!-- no --><script>n</script><a href=\"/l?a&amp;b\">link</a></body></html>"
    pages = spark.createDataFrame([(1, "http://x/", html, "c"), (2, None, None, "c"), (3, "http://y/", "", "c"), (3, "http://y/", "", "c")], "page_id long, url string, html string, block string")
    made = warc_derivatives.derivatives(warc_derivatives.responses(pages)).collect()
    assert len(made) == 8
    by = {(r.target_uri, r.warc_type): r for r in made}
    conv, meta = by["http://x/", "conversion"], by["http://x/", "metadata"]
    assert conv.record.split("\r\n\r\n", 1)[1] == "One\ntwo <3\nlink" or conv.record.split("\r\n\r\n", 1)[1] == "One\ntwo <3\n link"
    body = conv.record.split("\r\n\r\n", 1)[1]
    assert conv.content_length == len(body.encode()) and conv.block_digest == "sha256:" + brute.sha(body)
    assert meta.refers_to == conv.refers_to and f"WARC-Concurrent-To: {conv.record_id}" in meta.record and meta.source_payload_digest == "sha256:" + brute.sha(html)
    for want in ("source-status: 200\r\n", "source-header: Content-Type: text/html; charset=utf-8\r\n", "title: A & B\r\n", "outlink: /l?a&b\r\n"):
        assert want in meta.record
    warc_derivatives.write_records(spark.createDataFrame(made).coalesce(1), str(tmp_path / "w"))
    import gzip

    data = b"".join(gzip.open(tmp_path / "w" / f).read() for f in sorted(os.listdir(tmp_path / "w")) if f.endswith(".gz"))
    assert data.count(b"WARC/1.1\r\n") == 8 and data.endswith(b"\r\n\r\n")


def test_warc_hostile_pages(spark):
    """Unclosed and odd markup, against the SQL; and openers without end take no more than linear time."""
    import duckdb

    pages = [
        "a<!-- b", "a<script>x", "<title>T &#65;&#x42;&#0;&#xD800;&amp;#67;</title>x &#8364; &#99999999; y", "<a href='/q?a=1&amp;b'>l</a><A HREF = \"/z\">m</a><a href=\"", "1 < 2 and 3 > 2 <b>x</b>",
        "<p <p <div>z</p >", "<title>one<title>two", "&#39;&#x27;&apos;", "", "<head><meta name=x><title>h</title></head><body>b", "<style>s</style >t<!---->u<!-->v-->w", "\U0001f600 &#128512;",
    ]
    d = spark.createDataFrame([(k, f"http://x/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = warc_derivatives.derivatives(warc_derivatives.responses(d)).withColumn("record_sha256", F.sha2(F.col("record").cast("binary"), 256))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(k, f"http://x/{k}", p) for k, p in enumerate(pages)])
    want = con.execute(warc_derivatives.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in got.select(*names).collect())
    blocks = {(r.target_uri, r.warc_type): r.record.split("\r\n\r\n", 1)[1] for r in got.collect()}
    assert blocks["http://x/2", "conversion"] == "x € &#99999999; y"
    assert "title: T AB&#0;&#xD800;&#67;\r\n" in blocks["http://x/2", "metadata"]
    assert blocks["http://x/3", "metadata"].count("outlink: ") == 2 and "outlink: /q?a=1&b\r\n" in blocks["http://x/3", "metadata"]
    assert blocks["http://x/0", "conversion"] == "a" and blocks["http://x/4", "conversion"] == "1 < 2 and 3 > 2 x"
    hostile = [x * 250_000 for x in ("<!--", "<script ", "<p ", "<title>", "<a href=", "<a href='", "&#", "&#1;", "< ")]
    began = time.time()
    d = spark.createDataFrame([(k, "u", p) for k, p in enumerate(hostile)], "page_id long, url string, html string").repartition(len(hostile))
    assert warc_derivatives.derivatives(warc_derivatives.responses(d)).agg(F.sum("content_length")).first()[0] > 0
    assert time.time() - began < 90


OPERATORS = {
    "pii": pii_bootstrap.spans,
    "bpe": lambda d: byte_bpe.round_trip(d, RANKS, P.PATTERN),
    "lines": line_dedup.line_report,
    "quality": quality_rules.judged,
    "lm": bloom_lm.scores,
    "near": near_dedup.near_groups,
    "toxicity": lambda d: toxicity.toxicity(d, labels(d.sparkSession)),
    "exact": exact_dedup.exact_groups,
    "mix": source_mix.mix,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", list(OPERATORS))
def test_repeated_rows(name, repeated):
    got = OPERATORS[name](repeated).collect()
    assert sorted(r.doc_id for r in got) == [ROWS[0][0]] * 2 + [ROWS[61][0]] * 2 + [9_999]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_rows_without_doc_id(name, spark):
    """A null doc_id is reported as any other row."""
    rows = [(None, "to be or not to be, that is 10.0.0.1", "en", "s", 0), (None, "to be or not to be, that is 10.0.0.1", "en", "s", 0), (None, None, None, None, 0), (5, "to be or not to be, that is 10.0.0.1", "en", "s", 0), (6, "x", "en", None, 0)]
    got = OPERATORS[name](spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [5, 6, None, None, None]


KEEPING = {
    "toxicity": lambda d: toxicity.drop_toxic(d, labels(d.sparkSession)),
    "exact": exact_dedup.drop_copies,
    "near": near_dedup.drop_near_copies,
    "mix": source_mix.mixed_documents,
    "lines": line_dedup.drop_lines,
}


@pytest.mark.parametrize("name", list(KEEPING))
def test_columns_of_any_name_are_kept(name, docs, empty, repeated):
    got = KEEPING[name](docs)
    assert got.columns == docs.columns and all(r["stay_"] == "clash" for r in got.select("stay_").collect())
    assert KEEPING[name](empty).collect() == [] and KEEPING[name](repeated).columns == repeated.columns
    KEEPING[name](repeated).collect()


def test_pii_is_near_linear_in_one_text(spark):
    """A text of many identifiers, and one long word of digits."""
    n = 60_000
    texts = ["call +1 917 555 7017 or 10.0.0.1 at x " * (n // 10) + "code 77", "12345678 " * n, "1" * 400_000, "a@" * 200_000, "1." * 200_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    began = time.time()
    got = {r.doc_id: r for r in pii_bootstrap.spans(d).collect()}
    assert time.time() - began < 120
    assert got[0].n_ip == got[0].n_phone == n // 10 and got[0].base_sha256 == brute.sha(",".join(brute.pii(texts[0])[0]))


def test_empty_pages(spark):
    assert warc_derivatives.derivatives(warc_derivatives.responses(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []
