"""Operator 2: byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes groups of its documents, cuts the texts into pieces and replays the merges over all
different new pieces of a group at once. An inverted index maps the rank of a merge to the positions where its
pair stands; ranks are applied in order, and each merge looks at its two neighbours only and files
the new pairs under their ranks. Work is in proportion to the merges, so one word of a million
letters costs what a million letters of short words cost. A piece's ids do not depend on the rest
of the corpus, so pieces that a worker has seen are remembered, up to a fixed number.

A new pair with a lower rank than the merge at hand would have to come first. No vocabulary that was
trained by merging makes one in ordinary text; a piece where it happens is encoded on its own, pair
by pair, so the ids are exact for every rank table.

Edge cases: a null or empty text has no tokens (the digests are those of no bytes); repeated rows are
encoded alike; a table without rows gives none; further columns are ignored. Special tokens' strings
are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space, which the library's \s stands for (Python's own \s holds four more).
SPACE = "\t-\r \x85\xa0  -     　"
#: Runs without white space, with one space before them, and runs of white space; a match of the
#: tokenizer's pattern never crosses the border of such a segment.
SEGMENT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Segments, and pairs of tokens, that a worker remembers; bytes of texts whose new segments are learned at once,
#: of texts that stand as strings at a time, and of new pieces in one replay.
REMEMBERED, GROUP, SLICE, REPLAY = 150_000, 16 << 20, 1 << 20, 3 << 20
WALL, GONE = -1, -2  # ends a word; was merged into the symbol before


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count up from 0")
    return [t for _, t in pairs]


def packed_each(ids: np.ndarray) -> list[bytes]:
    """Each id as four bytes."""
    data = ids.tobytes()
    return [data[k : k + 4] for k in range(0, len(data), 4)]


def unpacked(packed: bytes) -> list[int]:
    return np.frombuffer(packed, np.int32).tolist()


class MergeReplay:
    """Encodes many byte strings at once by one rank table."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.merged: dict[int, int] = {}  # pair -> rank of the merged token, or -1
        self.packed = packed_each(np.arange(len(tokens), dtype=np.int32))

    def rank_of(self, left: int, right: int) -> int:
        key = left << 32 | right
        rank = self.merged.get(key)
        if rank is None:
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            rank = self.merged[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed as four bytes each."""
        result = [self.packed[r] if (r := self.ranks.get(p)) is not None else b"" for p in pieces]
        todo = [k for k, p in enumerate(pieces) if p and not result[k]]
        if not todo:
            return result
        lengths = np.array([len(pieces[k]) for k in todo]) + 1  # each word ends with a wall
        starts = np.cumsum(lengths) - lengths
        symbols = np.asarray(self.bytes)[np.frombuffer(b"\0".join(pieces[k] for k in todo) + b"\0", np.uint8)]
        symbols[starts + lengths - 1] = WALL
        out_of_order = self._replay(symbols)
        left = symbols != GONE
        ids = symbols[left].astype(np.int32).tobytes()
        ends = (np.cumsum(left)[starts + lengths - 1] - 1).tolist()
        lo = 0
        for k, hi in zip(todo, ends, strict=True):
            result[k] = ids[4 * lo : 4 * hi]
            lo = hi + 1
        for w in np.unique(np.searchsorted(starts, out_of_order, side="right") - 1):
            result[todo[w]] = self._one_by_one(pieces[todo[w]])
        return result

    def _replay(self, symbols: np.ndarray) -> np.ndarray:
        """Apply all merges to `symbols` in place, in rank order; places where a lower rank came up late."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        heap: list[int] = []
        late: list[np.ndarray] = []

        def file(at: np.ndarray, left: np.ndarray, right: np.ndarray, now: int) -> None:
            """Put pairs at `at` into the inverted index, under the ranks of their merges."""
            keys = left << 32 | right
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            heads = np.flatnonzero(np.diff(keys, prepend=-1))
            for lo, hi, key in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], keys[heads].tolist(), strict=True):
                a, b = key >> 32, key & 0xFFFFFFFF
                rank = self.rank_of(a, b)
                if rank < 0:
                    continue
                if rank < now:
                    late.append(at[lo:hi])
                elif rank in index:
                    index[rank].append((at[lo:hi], a, b))
                else:
                    index[rank] = [(at[lo:hi], a, b)]
                    heapq.heappush(heap, rank)

        at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        file(at, symbols[at], symbols[at + 1], -1)
        while heap:
            rank = heapq.heappop(heap)
            found = [p[(symbols[p] == a) & (symbols[after[p]] == b)] for p, a, b in index.pop(rank)]
            at = np.unique(np.concatenate(found))  # neighbours that merged at once filed their pair twice
            if not len(at):
                continue
            if len(at) > 1:  # of places that overlap, every second one from the left
                follows = np.concatenate([[False], at[1:] == after[at[:-1]]])
                if follows.any():
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone] = rank, GONE
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            x = symbols[ahead]  # at a first place this reads the last wall
            y = symbols[beyond]
            fore = (ahead >= 0) & (x >= 0)
            aft = y >= 0
            file(np.concatenate([ahead[fore], at[aft]]), np.concatenate([x[fore], np.full(aft.sum(), rank)]), np.concatenate([np.full(fore.sum(), rank), y[aft]]), rank)
        return np.concatenate(late) if late else np.zeros(0, np.int64)

    def _one_by_one(self, piece: bytes) -> bytes:
        ids = [self.bytes[b] for b in piece]
        while len(ids) > 1:
            rank, at = min(((r, k) for k in range(len(ids) - 1) if (r := self.rank_of(ids[k], ids[k + 1])) >= 0), default=(-1, 0))
            if rank < 0:
                break
            ids[at : at + 2] = [rank]
        return b"".join(self.packed[r] for r in ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder:
    """Texts to ids: segments, the tokenizer's pattern inside a segment, and the merge replay."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.replay = MergeReplay(tokens)
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The packed ids of each text.

        A group of texts is read twice: for its different new segments, which are learned together, and
        for the ids. Only a slice of it stands as strings at a time.
        """
        for lo, hi in _runs(texts, GROUP):
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            new: set[str] = set()
            group = texts.slice(lo, hi - lo)
            for a, b in _runs(group, SLICE):
                new.update(chain.from_iterable(map(SEGMENT.findall, group.slice(a, b - a).to_pylist())))
            self._learn(list(new - self.seen.keys()))
            for a, b in _runs(group, SLICE):
                for t in group.slice(a, b - a).to_pylist():
                    yield b"".join(map(self.seen.__getitem__, SEGMENT.findall(t)))

    def _learn(self, segments: list[str]) -> None:
        lo = 0
        while lo < len(segments):
            size, hi = 0, lo
            while hi < len(segments) and size < REPLAY:
                size += len(segments[hi])
                hi += 1
            part = segments[lo:hi]
            pieces = [self.pattern.findall(s) for s in part]
            new = list(set(chain.from_iterable(pieces)))
            ids = dict(zip(new, self.replay.encode([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
            for s, p in zip(part, pieces, strict=True):
                self.seen[s] = ids[p[0]] if len(p) == 1 else b"".join([ids[x] for x in p])
            lo = hi


def _runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First row and last row + 1 of runs of texts of about `most` bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts.cast(pa.binary())), dtype=np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


_encoders: dict[tuple[int, str], TextEncoder] = {}


def _encoder(tokens, pattern: str) -> TextEncoder:
    """One encoder in a Python worker, kept between its tasks."""
    key = (hash(tuple(tokens.value[-50:])), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(tokens.value, pattern)
    return _encoders[key]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text. The rank table, of fixed size, is broadcast."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokens, pattern)
        for batch in batches:
            packed = list(encoder.encode(batch.column(1)))
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.record_batch([batch.column(0), ids], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the bytes of every array of ids; null ids are no bytes."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [b"".join(map(tokens.value.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokens, pattern)
        text_of = [str(k) for k in range(len(tokens.value))].__getitem__
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for ids in map(unpacked, encoder.encode(batch.column(1))):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(text_of, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(encoder.replay.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
