"""Operator 5: language-model scores from a log-frequency Bloom filter.

Counting. Tokens are words (A-Z lower-cased) and one end for each text. Documents are taken in slices
of bounded bytes, and a slice asks for each of its different n-grams once. The questions, packed with
the slice's own counts of training rows, are dealt to buckets by a hash of the n-gram; their number
grows with the bytes of all texts, so that a bucket stays small at every size of the input. A bucket
sums the counts of its n-grams, every one that occurs in a training row.

Model. Each bucket holds one segment of the filter, sized from its number of entries. An n-gram of two
words or more with a count in [RATIO**(j - 1), RATIO**j) is put into it j times, as (n-gram, 1) to
(n-gram, j). A query probes level 1, 2, ... until the first miss, and the last hit gives the quantised
count: the lower end of its level, and the upper end for a history, so that probabilities never sum to
more than 1. The counts of words, which the base score needs, are exact. Orders are mixed: with a known
history, p(w | history) = MIX * count(history, w) / count(history) + (1 - MIX) * p(w | shorter history),
and p(w) = (count(w) + 1) / (all tokens + different tokens + 1).

The answers, packed as the questions were, go back to the slices, which add up the scores of their rows.

Edge cases: a null or empty text is the end alone; repeated rows are scored each; without training
rows every count is 0; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import written
from loomwork.llm.text_arrays import LOWER, byte_slices, mix, word_hashes, word_spans

ORDER = 2
RATIO = 1.2
MIX = 0.15
#: Segments of a filter and bits of each (a power of 2) where nothing else is said, and bits that one entry sets.
SEGMENTS, SEGMENT_BITS, PROBES = 16, 1 << 23, 5
#: Bits of a segment for each entry, at least; bytes of text in a slice, and those of all texts for each bucket.
ENTRY_BITS, SLICE_BYTES, BUCKET_BYTES = 16, 12 << 20, 8 << 20
END = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, ends included, and the number of tokens of each text."""
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets)
    return np.insert(word_hashes(data, starts, ends), np.cumsum(counts), END), counts + 1


def grams(tokens: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """At each token the fingerprints of the 1-gram, 2-gram ... that end there; before a text stand ends."""
    first = np.cumsum(counts) - counts
    out, back = [tokens], tokens
    for k in range(1, order):
        back = np.concatenate([[END], back[:-1]])
        back[first] = END
        out.append(mix(out[-1] * np.uint64(0xBF58476D1CE4E5B9) + back + np.uint64(k)))
    return out


def histories(levels: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """At each token the fingerprint of the 1-gram, 2-gram ... that ends just before it."""
    first = np.cumsum(counts) - counts
    out, start = [], END
    for k, g in enumerate(levels):
        h = np.concatenate([[END], g[:-1]])
        h[first] = start
        out.append(h)
        start = mix(np.array([start], np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + END + np.uint64(k + 1))[0]
    return out


class LogFrequencyFilter:
    """Membership of (n-gram, level), in segments by n-gram."""

    def __init__(self, bits: np.ndarray, least: float):
        self.bits, self.least = bits, least  # bits: segments x bits of each / 8 bytes

    @staticmethod
    def segment(g: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
        return (mix(g ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(24)) % np.uint64(segments)

    @staticmethod
    def places(g: np.ndarray, level: int, n_bits: int = SEGMENT_BITS) -> list[np.ndarray]:
        h = mix(g + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [(h + np.uint64(i) * step) % np.uint64(n_bits) for i in range(PROBES)]

    def levels(self, g: np.ndarray) -> np.ndarray:
        """The level of each of different n-grams: the last one that hits, 0 where level 1 misses."""
        level, left, segment = np.zeros(len(g), np.int64), np.arange(len(g)), self.segment(g, len(self.bits))
        j = 0
        while len(left):
            j += 1
            hit = np.ones(len(left), bool)
            for p in self.places(g[left], j, 8 * self.bits.shape[1]):
                hit &= (self.bits[segment[left], p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[hit]
            level[left] = j
        return level

    def count(self, g: np.ndarray) -> np.ndarray:
        """The quantised count of each n-gram: the lower end of its level, 0 where level 1 misses."""
        own, back = np.unique(g, return_inverse=True)
        return lower_end(self.levels(own), self.least)[back]


def lower_end(level: np.ndarray, least: float = 1.0) -> np.ndarray:
    """The least count of a level, 0 of level 0."""
    return np.where(level > 0, least * RATIO ** (level - 1.0), 0.0)


def build_segment(g: np.ndarray, n: np.ndarray) -> LogFrequencyFilter:
    """The filter of one bucket's different n-grams, with their counts of 1 or more."""
    levels = 1 + np.floor(np.log(n) / math.log(RATIO)).astype(int)
    n_bits = 1 << max(10, (ENTRY_BITS * int(levels.sum())).bit_length())
    bits = np.zeros(n_bits, bool)
    for j in range(1, levels.max(initial=0) + 1):
        for p in LogFrequencyFilter.places(g[levels >= j], j, n_bits):
            bits[p] = True
    return LogFrequencyFilter(np.packbits(bits, bitorder="little")[None], 1.0)


def asked(words: np.ndarray, ranks: np.ndarray, counts: np.ndarray, order: int, buckets: int) -> Iterator[tuple]:
    """For each order of a slice: its different n-grams by bucket, their buckets, and the places of its
    n-grams and of its histories in them (those of the last order are no histories)."""
    levels = grams(words[ranks], counts, order)
    past = histories(levels, counts)
    for k in range(order):
        g, back = np.unique(np.concatenate([levels[k], past[k][:0] if k + 1 == order else past[k]]), return_inverse=True)
        bucket = LogFrequencyFilter.segment(g, buckets).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(g), np.int64)
        place[by] = np.arange(len(g))
        back = place[back]
        yield g[by], bucket[by], back[: len(ranks)], back[len(ranks) :]


_SLICES = "slice long, ids array<bigint>, held array<boolean>, counts binary, words binary, ranks binary"
_ASKED = "bucket int, slice long, k int, g binary, n binary"
_REPLIES = "slice long, bucket int, k int, answer binary, n_all long, n_different long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def slices(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, held_out, text) in slices, with the fingerprints of their words and each token's rank in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(2), SLICE_BYTES):
                tokens, counts = token_stream(data, offsets)
                words, ranks = np.unique(tokens, return_inverse=True)
                lists = [pa.array([batch.column(c).slice(lo, hi - lo).to_pylist()], t) for c, t in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.bool_())))]
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (counts.astype(np.int64), words, ranks.astype(np.int32))]
                yield pa.record_batch([pa.array([at]), *lists, *packed], names=["slice", "ids", "held", "counts", "words", "ranks"])
                at += 1

    return docs.mapInArrow(run, _SLICES)


def _unpacked(table: pa.Table | pa.RecordBatch, row: int) -> list[np.ndarray]:
    return [np.frombuffer(table.column(c)[row].as_py(), t) for c, t in (("counts", np.int64), ("words", np.uint64), ("ranks", np.int32))]


def replies(cut: DataFrame, order: int, buckets: int) -> DataFrame:
    """The answers of each bucket to each slice: the exact counts of words, the levels of longer n-grams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                counts, words, ranks = _unpacked(batch, row)
                train = np.repeat(~np.array(batch.column("held")[row].as_py(), bool), counts)
                for k, (g, bucket, place, _) in enumerate(asked(words, ranks, counts, order, buckets)):
                    n = np.bincount(place[train], minlength=len(g)).astype(np.int32)
                    which, first = np.unique(bucket, return_index=True)
                    ends = [*first[1:], len(g)]
                    out = [pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for x in (g, n)]
                    same = [np.full(len(which), x) for x in (batch.column("slice")[row].as_py(), k)]
                    yield pa.record_batch([pa.array(which.astype(np.int32)), pa.array(same[0].astype(np.int64)), pa.array(same[1].astype(np.int32)), *out], names=["bucket", "slice", "k", "g", "n"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        ks = table.column("k").to_numpy()
        answers: list[bytes] = [b""] * len(ks)
        n_all = n_different = 0
        for k in range(order):
            rows = np.flatnonzero(ks == k)
            if not len(rows):
                continue
            parts = [np.frombuffer(table.column("g")[int(r)].as_py(), np.uint64) for r in rows]
            g, back = np.unique(np.concatenate(parts), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([np.frombuffer(table.column("n")[int(r)].as_py(), np.int32) for r in rows]), minlength=len(g)).astype(np.int64)
            if k == 0:
                found, n_all, n_different = n, int(n.sum()), int((n > 0).sum())
            else:
                found = build_segment(g[n > 0], n[n > 0]).levels(g).astype(np.uint8)
            found, at = found[back], 0
            for r, part in zip(rows, parts, strict=True):
                answers[r] = found[at : at + len(part)].tobytes()
                at += len(part)
        first = np.arange(len(ks)) == 0
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "k": table.column("k"), "answer": pa.array(answers, pa.binary()), "n_all": pa.array(np.where(first, n_all, 0)), "n_different": pa.array(np.where(first, n_different, 0))})

    return cut.mapInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(answer, _REPLIES)


def scores(docs: DataFrame, order: int = ORDER, weight: float = MIX) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    cut = written(slices(docs), "lm-slices")
    found = written(replies(cut, order, buckets), "lm-replies")
    n_all, n_different = found.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_different"), F.lit(0))).first()
    whole = math.log10(n_all + n_different + 1)

    def run(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        counts, words, ranks = _unpacked(own, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        ks, by = told.column("k").to_numpy(), np.argsort(told.column("bucket").to_numpy(), kind="stable")
        past_count = np.zeros(0)
        for k, (_, _, place, past) in enumerate(asked(words, ranks, counts, order, buckets)):
            told_k = b"".join(told.column("answer")[int(r)].as_py() for r in by[ks[by] == k])
            if k == 0:
                c = np.frombuffer(told_k, np.int64)
                base = np.log10(c[place] + 1.0) - whole
                is_known, p, upper = c[place] > 0, 10**base, c.astype(float)
            else:
                lower = lower_end(np.frombuffer(told_k, np.uint8).astype(np.int64))
                hit = np.minimum(lower[place] / np.maximum(past_count, 1.0), 1.0)
                p = np.where(past_count > 0, weight * hit + (1 - weight) * p, p)
                upper = RATIO * lower  # so that no history's shares exceed 1
            past_count = upper[past]
        known, base, score = (np.bincount(doc, weights=x, minlength=len(counts)) for x in (is_known, base, np.log10(p)))
        columns = [own.column("ids").combine_chunks().flatten(), own.column("held").combine_chunks().flatten(), counts, known.astype(np.int64), base, score]
        return pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    # a group has one slice: its number is given to it alone
    out = cut.groupBy("slice").cogroup(found.select("slice", "bucket", "k", "answer").groupBy("slice")).applyInArrow(run, _SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
