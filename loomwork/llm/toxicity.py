"""Operator 7: toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs of the network at each word: a vector of the word, if it is one of the vocabulary that the
training rows give, and the mean vector of its character trigrams, which reaches inflected and
unseen forms. All windows of WINDOW words, STRIDE apart and the last one at the text's end, are
scored, so any WINDOW - STRIDE words in a row stand whole in a window; two directions of gated
recurrent units run over a window, attention weighs their states, and the text's score is that of its
highest window. Training takes windows COARSE apart. Gradients are written out in NumPy.

Training takes a bounded sample of the labelled rows outside the held-out fold: at most SAMPLE rows
of either label, in the order of a hash of doc_id, with their whole texts. Weights and vocabulary have
a fixed size and are broadcast. Scoring reads every whole text.

Edge cases: an empty or null text, or one without letters or digits, has one empty window and its
score; repeated rows are scored alike; a null doc_id is scored as any other and is in no fold; a label
without a document, or null, teaches nothing; without rows of both labels every score is 0; an empty
table gives none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.shared import fresh
from loomwork.llm.text_arrays import LOWER, byte_slices, word_hashes, word_spans

WINDOW, STRIDE, COARSE = 32, 8, 24
SAMPLE = 1_500
VOCABULARY, LEAST_TEXTS = 6_000, 3
TRIGRAMS, D_WORD, D_CHAR, HIDDEN, ATTENTION = 1 << 14, 8, 12, 8, 6
LOOK = 60  # steps between two looks at the rows that are kept back; the best weights stay
STEPS, TOXIC_PER_STEP, CLEAN_PER_STEP, RATE, DECAY, SMOOTH = 420, 24, 40, 0.01, 0.3, 0.03
CUT = 0.3

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Words:
    """The words of a slice of texts: different words with their trigrams, and windows of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        starts, ends, self.counts = word_spans(data, offsets, LETTERS)
        self.hash, first, self.which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        starts, ends = starts[first], ends[first]
        self.lengths = ends - starts
        # each byte of a word with its two neighbours; outside the word stands 0
        own = np.repeat(starts - np.concatenate([[0], np.cumsum(self.lengths)[:-1]]), self.lengths) + np.arange(self.lengths.sum())
        at = data[own].astype(np.uint32)
        begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        left, right = np.concatenate([[0], at[:-1]]).astype(np.uint32), np.concatenate([at[1:], [0]]).astype(np.uint32)
        left[begins] = 0
        right[begins[1:] - 1] = 0
        self.begins = begins
        self.trigrams = (((left * np.uint32(0x01000193) ^ at) * np.uint32(0x01000193) ^ right) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)

    def some(self, used: np.ndarray) -> Words:
        """Only the different words `used`, in this order, without the texts."""
        out = object.__new__(Words)
        out.hash, out.lengths = self.hash[used], self.lengths[used]
        out.begins = np.cumsum(out.lengths) - out.lengths
        out.trigrams = self.trigrams[np.repeat(self.begins[used] - out.begins, out.lengths) + np.arange(out.lengths.sum())]
        return out

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: its text, the place of its first word, its number of words."""
        n = np.maximum(1, 1 + -(-np.maximum(self.counts - WINDOW, 0) // stride))
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.minimum(k * stride, np.maximum(self.counts[text] - WINDOW, 0))
        base = np.cumsum(self.counts) - self.counts
        return text, base[text] + start, np.minimum(self.counts[text], WINDOW)


class Network:
    """Weights, scores of windows and gradients."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        g = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        d, h = D_WORD + D_CHAR, HIDDEN
        self.vocabulary = vocabulary  # sorted fingerprints
        self.shift = 0.0
        self.p = {"words": g(len(vocabulary) + 1, D_WORD), "chars": g(TRIGRAMS, D_CHAR), "W": g(2, d, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "U": g(2, h, 3 * h), "A": g(2 * h, ATTENTION), "a0": np.zeros(ATTENTION, np.float32), "v": g(ATTENTION), "o": g(2 * h), "o0": np.full(1, -2.0, np.float32)}
        self.p["words"][-1] = 0  # of unknown words

    def word_ids(self, words: Words) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(words.hash), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hash, at, len(self.vocabulary))

    def inputs(self, words: Words) -> np.ndarray:
        """The input vectors of the different words; a last row of zeros stands for no word."""
        x = np.zeros((len(words.hash) + 1, D_WORD + D_CHAR), np.float32)
        if len(words.hash):
            x[:-1, :D_WORD] = self.p["words"][self.word_ids(words)]
            x[:-1, D_WORD:] = np.add.reduceat(self.p["chars"][words.trigrams], words.begins, axis=0) / words.lengths[:, None]
        return x

    def forward(self, projected: np.ndarray, tokens: np.ndarray, keep: bool = False):
        """Logits of windows. projected: (2, words + 1, 3 * HIDDEN); tokens: (windows, WINDOW), -1 for none."""
        p, h3 = self.p, 3 * HIDDEN
        n = len(tokens)
        real = (tokens >= 0).astype(np.float32)
        full = bool(real.all())
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((2, WINDOW, n, HIDDEN), np.float32)
        trail = []
        for t in range(WINDOW):
            own = (t, WINDOW - 1 - t)
            x = np.stack([projected[0][tokens[:, own[0]]], projected[1][tokens[:, own[1]]]])
            u = h @ p["U"]
            gates = sigmoid(x[:, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
            r, z = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
            c = np.tanh(x[:, :, 2 * HIDDEN : h3] + r * u[:, :, 2 * HIDDEN :])
            move = 1.0 - z
            if not full:
                move = move * np.stack([real[:, own[0]], real[:, own[1]]])[:, :, None]
            new = h + move * (c - h)
            if keep:
                trail.append((h, r, z, c, u[:, :, 2 * HIDDEN :], move))
            h = new
            states[0, own[0]], states[1, own[1]] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], axis=2)  # (WINDOW, windows, 2 * HIDDEN)
        q = np.tanh(both @ p["A"] + p["a0"])
        e = q @ p["v"]
        if not full:
            e = np.where(real.T > 0, e, -30.0)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        if not full:
            w = w * real.T
        pooled = np.einsum("tn,tnh->nh", w, both)
        logit = pooled @ p["o"] + p["o0"][0]
        return (logit, (real, trail, both, q, w, pooled)) if keep else logit

    def gradients(self, words: Words, x: np.ndarray, tokens: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the windows `tokens`."""
        p, hd = self.p, HIDDEN
        projected = x @ p["W"] + p["b"]
        logit, (real, trail, both, q, w, pooled) = self.forward(projected, tokens, keep=True)
        g = {k: np.zeros_like(a) for k, a in p.items() if k not in ("words", "chars")}
        d = ((sigmoid(logit) - target) / len(target)).astype(np.float32)
        g["o"], g["o0"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * p["o"]
        d_both = w[:, :, None] * d_pooled
        d_w = np.einsum("tnh,nh->tn", both, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_e, q)
        d_q = d_e[:, :, None] * p["v"] * (1 - q * q)
        g["A"] = np.einsum("tnh,tna->ha", both, d_q)
        g["a0"] = d_q.sum(axis=(0, 1))
        d_both += d_q @ p["A"].T
        d_in = np.zeros((2, len(tokens), WINDOW, 3 * hd), np.float32)
        d_h = np.zeros((2, len(tokens), hd), np.float32)
        for t in reversed(range(WINDOW)):
            own = (t, WINDOW - 1 - t)
            h, r, z, c, uc, move = trail[t]
            d_h = d_h + np.stack([d_both[own[0], :, :hd], d_both[own[1], :, hd:]])
            d_c = d_h * move * (1 - c * c)
            mask = np.stack([real[:, own[0]], real[:, own[1]]])[:, :, None]
            d_z = -d_h * (c - h) * mask * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            d_u = np.concatenate([d_r, d_z, d_c * r], axis=2)
            g["U"] += h.transpose(0, 2, 1) @ d_u
            d_x = np.concatenate([d_r, d_z, d_c], axis=2)
            d_in[0, :, own[0]], d_in[1, :, own[1]] = d_x[0], d_x[1]
            d_h = d_h * (1 - move) + d_u @ p["U"].transpose(0, 2, 1)
        flat = tokens.reshape(-1)
        there = flat >= 0
        d_in = d_in.reshape(2, -1, 3 * hd)[:, there]
        used, back = np.unique(flat[there], return_inverse=True)
        sums = np.zeros((2, len(used), 3 * hd), np.float32)
        for k in (0, 1):
            np.add.at(sums[k], back, d_in[k])
        g["b"] = sums.sum(axis=1, keepdims=True)
        g["W"] = x[used].T[None] @ sums
        d_x = (sums @ p["W"].transpose(0, 2, 1)).sum(axis=0)
        ids = self.word_ids(words)[used]
        g["words"] = (ids, d_x[:, :D_WORD])
        reps = words.lengths[used]
        spots = np.repeat(words.begins[used] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        g["chars"] = (words.trigrams[spots].astype(np.int64), np.repeat(d_x[:, D_WORD:] / reps[:, None], reps, axis=0))
        return g


def _tokens(words: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    out = np.full(at.shape, -1, np.int64)
    real = np.arange(WINDOW) < length[:, None]
    out[real] = words.which[at[real]]
    return out


def text_logits(net: Network, words: Words, batch: int = 2048, only: np.ndarray | None = None, stride: int = STRIDE) -> np.ndarray:
    """The highest logit of each text's windows; -inf for texts outside `only`."""
    text, start, length = words.windows(stride)
    if only is not None:
        out = np.full(len(words.counts), -np.inf)
        text, start, length = text[only[text]], start[only[text]], length[only[text]]
    projected = net.inputs(words) @ net.p["W"] + net.p["b"]
    logit = np.concatenate([net.forward(projected, _tokens(words, start[k : k + batch], length[k : k + batch])) for k in range(0, len(text), batch)])
    top = np.maximum.reduceat(logit, np.flatnonzero(np.diff(text, prepend=-1))) + net.shift
    if only is None:
        return top
    out[only] = top
    return out


def train(texts: list[bytes], toxic: np.ndarray, steps: int = STEPS, seed: int = 3) -> Network | None:
    """The network, or None without texts of both labels."""
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return None
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    text_of = np.repeat(np.arange(len(texts)), words.counts)
    pairs = np.unique(words.which.astype(np.int64) * len(texts) + text_of) // len(texts)
    n_texts = np.bincount(pairs, minlength=len(words.hash))
    often = np.argsort(-n_texts, kind="stable")[:VOCABULARY]
    net = Network(np.sort(words.hash[often[n_texts[often] >= LEAST_TEXTS]]))
    text, start, length = words.windows(COARSE)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    last = np.append(first[1:], len(text))
    rng = np.random.Generator(np.random.PCG64(seed))
    check = rng.random(len(texts)) < 0.2  # not trained on; sets the shift
    if len(set(toxic[check])) < 2 or len(set(toxic[~check])) < 2:
        check[:] = False
    bad, good = np.flatnonzero(toxic & ~check), np.flatnonzero(~toxic & ~check)
    held = check if check.any() else np.ones(len(texts), bool)
    best = (np.inf, net.p)
    moments: dict[str, list] = {k: [np.zeros_like(a), np.zeros_like(a)] for k, a in net.p.items()}
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(bad, min(TOXIC_PER_STEP, len(bad)), replace=False), rng.choice(good, min(CLEAN_PER_STEP, len(good)), replace=False)])
        spans = np.concatenate([np.arange(first[d], last[d]) for d in docs])
        tokens = _tokens(words, start[spans], length[spans])
        there = tokens >= 0
        used, tokens[there] = np.unique(tokens[there], return_inverse=True)
        own = words.some(used)
        x = net.inputs(own)
        projected = x @ net.p["W"] + net.p["b"]
        logit = net.forward(projected, tokens)
        heads = np.cumsum([0, *(last[d] - first[d] for d in docs)])
        top = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(heads[:-1], heads[1:], strict=True)])
        any_clean = rng.integers(0, len(spans), 24)
        any_clean = any_clean[~toxic[text[spans[any_clean]]]]
        rows = np.concatenate([top, any_clean])
        target = np.concatenate([toxic[docs], np.zeros(len(any_clean), bool)]).astype(np.float32)
        target = SMOOTH + (1 - 2 * SMOOTH) * target
        _adam(net, net.gradients(own, x, tokens[rows], target), moments, step, RATE * min(1.0, 2.0 * (1 - step / (steps + 1))))
        if step % LOOK == 0 or step == steps:
            loss = _balanced_loss(text_logits(net, words, only=held, stride=COARSE)[held], toxic[held])
            if loss < best[0]:
                best = (loss, {k: a.copy() for k, a in net.p.items()})
    net.p = best[1]
    logit = text_logits(net, words, only=held)
    net.shift = float(np.log(CUT / (1 - CUT)) - _best_cut(logit[held], toxic[held]))
    return net


def _adam(net: Network, grads: dict, moments: dict, step: int, rate: float) -> None:
    for k, g in grads.items():
        m, v = moments[k]
        if isinstance(g, tuple):  # rows of a table of vectors
            rows, back = np.unique(g[0], return_inverse=True)
            total = np.zeros((len(rows), g[1].shape[1]), np.float32)
            np.add.at(total, back, g[1])
            if k == "words":
                rows, total = rows[rows < len(net.vocabulary)], total[rows < len(net.vocabulary)]
            g, at = total, rows
        else:
            at = slice(None)
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        net.p[k][at] -= rate * DECAY * net.p[k][at]
        net.p[k][at] -= rate * (m[at] / (1 - 0.9 ** min(step, 200))) / (np.sqrt(v[at] / (1 - 0.99 ** min(step, 900))) + 1e-6)


def _balanced_loss(logit: np.ndarray, toxic: np.ndarray) -> float:
    """Cross-entropy with both labels weighing the same."""
    loss = np.logaddexp(0.0, np.where(toxic, -logit, logit))
    return float(loss[toxic].mean() + loss[~toxic].mean())


def _best_cut(logit: np.ndarray, toxic: np.ndarray) -> float:
    """Between two logits, where the recall of toxic and of clean texts is best in sum; the middle of the best gap."""
    order = np.argsort(logit)
    values, labels = logit[order], toxic[order]
    clean_below = np.concatenate([[0], np.cumsum(~labels)]) / max(1, (~labels).sum())
    toxic_above = 1 - np.concatenate([[0], np.cumsum(labels)]) / max(1, labels.sum())
    best = int(np.argmax(clean_below + toxic_above))
    return float(0.5 * (values[max(best - 1, 0)] + values[min(best, len(values) - 1)]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """The bounded sample, on the driver."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*order).limit(most).unionByName(known.where("toxic = 0").orderBy(*order).limit(most))
    ids = ids.select(F.col("doc_id").alias("id"), "toxic")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # 2 * most ids at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).orderBy(*order).collect()
    return [r.text.encode() for r in rows], np.array([r.toxic for r in rows], dtype=int)


def score(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """All rows with their columns and a score (double), and that column's name."""
    net = train(*training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at, name = docs.columns.index("text"), fresh(docs, "score_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if net is not None:
                for lo, hi, data, offsets in byte_slices(batch.column(at), 1 << 20):
                    scores[lo:hi] = sigmoid(text_logits(net, Words(data, offsets)))
            yield pa.record_batch([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema), name


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out, name = score(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with the columns of the input."""
    out, name = score(docs, labels)
    return out.where(F.col(name) < CUT).drop(name)
