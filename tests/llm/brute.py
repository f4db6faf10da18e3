"""Plain versions of the operators over lists of rows (doc_id, text, lang, source)."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(s):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(s)))) % 10 == 0


def pii(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out, n = [], collections.Counter()
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text or ""):
            hit = m.group()
            digits = re.sub("[^0-9]", "", hit)
            okay = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if okay:
                out.append(f"{kind}:{m.start()}:{m.end()}")
                n[kind] += 1
    return out, [n[k] for k, _ in kinds]


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, covered = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered.update((k, k + 1, k + 2))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def lm_base(rows):
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for (i, _), t, h in zip(rows, tokens, held, strict=True)]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b:
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)]


def exact(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    keep, n = {}, collections.Counter(texts)
    for (i, _), t in zip(rows, texts, strict=True):
        keep[t] = min(keep.get(t, i), i)
    return [(i, keep[t], n[t], i == keep[t], sha(t)) for (i, _), t in zip(rows, texts, strict=True)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def within(a, b, edits):
    """Whether the distance is at most `edits`, by trying each edit at the first difference."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b or not edits:
        return len(a) + len(b) <= edits
    return within(a[1:], b, edits - 1) or within(a, b[1:], edits - 1) or within(a[1:], b[1:], edits - 1)


def lines(rows, edits=2, min_chars=24):
    own = [[(k, x) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in rows]
    first = {}
    for (i, _), ls in zip(rows, own, strict=True):
        for k, x in ls:
            first[x] = min(first.get(x, (i, k)), (i, k), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    long = [x for x in first if len(x) >= min_chars]
    n_links, late = collections.Counter(), set()
    for p, x in enumerate(long):
        for y in long[:p]:
            if abs(len(x) - len(y)) <= edits and within(x, y, edits):
                n_links[x] += 1
                n_links[y] += 1
                late.add(max(x, y, key=lambda z: (first[z][0] is None, first[z][0] or 0, first[z][1])))
    out = []
    for (i, _), ls in zip(rows, own, strict=True):
        mine = [x for k, x in ls if first[x] == (i, k)]
        stay = [x for x in mine if x not in late]
        out.append((i, len(ls), len(ls) - len(mine), len(mine) - len(stay), sum(n_links[x] for x in mine), sha("".join(map(sha, stay)))))
    return out


def targets(sizes):
    """source -> target of a dict source -> words (None last): reshare until no source is above twice its words."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while True:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]] if total else []
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())


def _mix_plan(rows, order, block):
    """Targets, sizes, the source of each slot, and of each row its places (first word of each copy) and size."""
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = targets(size)
    names = sorted(s for s in size if s is not None) + ([None] if None in size else [])
    total, ends, at = sum(want.values()), [], 0.0
    for s in names:
        at += want[s] / total
        ends.append((at, s))
    ends[-1] = (2.0, ends[-1][1])
    golden = (math.sqrt(5) - 1) / 2
    slots = [next(s for end, s in ends if math.fmod((k + 1) * golden, 1.0) < end) for k in range(math.ceil(total / block))]
    places, stream = {}, collections.Counter()
    for i, t, s in sorted(rows, key=lambda r: (order[r[0]], r[0])):
        n = len(WORD.findall(t or ""))
        places[i] = [stream[s], stream[s] + size[s]], n
        stream[s] += n
    return want, size, slots, places


def mixed(rows, order, block):
    """doc_id -> (taken, first slot, last slot), by dealing the words of one block after another to the slots."""
    want, size, slots, places = _mix_plan(rows, order, block)
    at = collections.defaultdict(list)  # of each source the slot of each block
    for k, s in enumerate(slots):
        at[s].append(k)
    out = {}
    for i, _, s in rows:
        starts, n = places[i]
        words = [w for p in starts for w in range(p, p + n) if w // block < len(at[s]) and w < 2 * size[s]]
        hit = [at[s][w // block] for w in words]
        out[i] = (len(words), min(hit, default=None), max(hit, default=None))
    return out, want, size, slots


def mixed_copies(rows, order, block):
    """doc_id -> how many of its copies have half of their words or more taken."""
    _, size, slots, places = _mix_plan(rows, order, block)
    n_slots = collections.Counter(slots)
    out = collections.Counter()
    for i, _, s in rows:
        starts, n = places[i]
        words = min(n_slots[s] * block, 2 * size[s])
        out[i] = sum(n > 0 and 2 * max(0, min(words - p, n)) >= n for p in starts)
    return out


def jensen_shannon(p, q):
    half = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, 0.5 * sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q, strict=True))))


def shares(h):
    return [x / max(1.0, sum(h)) for x in h]


def quality_verdicts(rows, q):
    """doc_id -> (character distance, word distance, kept) of rows (doc_id, text, lang); `q` has the operator's parameters."""
    found, refs = {}, {}
    for i, text, lang in rows:
        n, chars, *_, failed = base = quality(text)
        text = text or ""
        kinds = [len(re.findall(c, text)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^\x00-\x7F]")]
        kinds.append(max(0, chars - sum(kinds)))
        words = [w.lower() for w in WORD.findall(text)]
        usual = [words.count(c) for c in q.COMMON]
        usual.append(n - sum(usual))
        found[i] = (base, kinds, usual, lang)
        if not failed:
            r = refs.setdefault(lang, [0, [0] * 5, [0] * len(usual)])
            refs[lang] = [r[0] + n, [a + b for a, b in zip(r[1], kinds, strict=True)], [a + b for a, b in zip(r[2], usual, strict=True)]]
    out = {}
    for i, (base, kinds, usual, lang) in found.items():
        n, chars, *_, failed = base
        total, ref_kinds, ref_usual = refs.get(lang, (0, [0] * 5, [0] * len(usual)))
        known = total >= q.MIN_REFERENCE
        ref_kinds, ref_usual = shares(ref_kinds), shares(ref_usual)
        c = jensen_shannon(shares(kinds), ref_kinds) if known and chars >= q.MIN_CHARS else None
        w = jensen_shannon(shares(usual), ref_usual) if known and n >= q.MIN_WORDS else None
        limit = q.WORD_LIMIT
        if ref_usual[-1] <= 1 - q.MIN_COMMON:
            limit = min(limit, (q.WORD_SHARE + q.WORD_NOISE / math.sqrt(max(n, 1))) * jensen_shannon([0.0] * len(q.COMMON) + [1.0], ref_usual))
        out[i] = (c, w, not failed and not (c or 0) > q.CHARACTER_LIMIT and not (w or 0) > limit)
    return out


def lm_scores(rows, ratio, mix):
    """doc_id -> log10 probability: bigram counts at the lower end of their level, words with one added."""
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    c, pairs = collections.Counter(), collections.Counter()
    for i, t in tokens:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t)
            pairs.update(zip([None, *t[:-1]], t, strict=True))
    whole = sum(c.values()) + len(c) + 1
    level = {p: ratio ** math.floor(math.log(n) / math.log(ratio)) for p, n in pairs.items()}
    out = {}
    for i, t in tokens:
        total = 0.0
        for h, w in zip([None, *t[:-1]], t, strict=True):
            p = (c[w] + 1) / whole
            if c[h]:
                p = mix * min(level.get((h, w), 0.0) / c[h], 1.0) + (1 - mix) * p
            total += math.log10(p)
        out[i] = total
    return out


def gru_logit(p, inputs):
    """The logit of one window (a list of word vectors), unit by unit, by the network's definition."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    n = len(p["U"][0])
    states = []
    for side, order in ((0, range(len(inputs))), (1, reversed(range(len(inputs))))):
        h, trail = [0.0] * n, {}
        for t in order:
            x = [sum(inputs[t][k] * p["W"][side][k][j] for k in range(len(inputs[t]))) + p["b"][side][0][j] for j in range(3 * n)]
            u = [sum(h[k] * p["U"][side][k][j] for k in range(n)) for j in range(3 * n)]
            r, z = [sig(x[j] + u[j]) for j in range(n)], [sig(x[n + j] + u[n + j]) for j in range(n)]
            c = [math.tanh(x[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(n)]
            trail[t] = h
        states.append(trail)
    both = [[*states[0][t], *states[1][t]] for t in range(len(inputs))]
    e = [sum(math.tanh(sum(s[k] * p["A"][k][j] for k in range(2 * n)) + p["a0"][j]) * p["v"][j] for j in range(len(p["v"]))) for s in both]
    w = [math.exp(v - max(e)) for v in e] if e else []
    pooled = [sum(a * s[k] for a, s in zip(w, both, strict=True)) / sum(w) for k in range(2 * n)] if w else [0.0] * (2 * n)
    return sum(a * b for a, b in zip(pooled, p["o"], strict=True)) + p["o0"][0]
