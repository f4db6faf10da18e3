"""Operator 8: Grace hash deduplication of whole texts.

Texts are equal when they are identical after every run of white space became one space. Two steps:

1. Each task first merges the equal texts among its own rows, so that a text with very many copies
   leaves at most a few representatives per task (this is the pre-aggregation before the shuffle).
2. Representatives are partitioned by a hash of their content; the shuffle's files are the spill
   files. A bucket's task fills an open-addressing table, comparing complete contents, up to a fixed
   number of bytes. Contents that no longer fit are written out unresolved and go to the next level,
   which partitions them by another hash, until nothing is left. A content in the table takes in all
   its copies, however many, and one that was turned away is turned away each time in this level, so
   every group is resolved in exactly one place.

Of each group the row with the smallest doc_id stays, of several with that doc_id the first; a null
doc_id comes after all others. `drop_copies` tells rows apart by a written number of their own, so rows
of one doc_id with different texts, and rows without a doc_id, stay as any other row does.

Edge cases: a null text equals an empty one; rows repeated with one doc_id and text are all marked
kept if the doc_id is the group's smallest (`drop_copies` leaves one of them); of a null doc_id kept is
null, as in SQL; a table without rows gives none; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import kept_rows, numbered, written
from loomwork.llm.text_arrays import squeezed

#: Bytes of content that one task's table holds.
TABLE_BYTES = 48 << 20

_LOCAL = "doc_id long, row long, part int, seq long, n long, h long, n_bytes long, content binary"
_PASS = "part int, seq long, first_id long, first_row long, n long, h long, n_bytes long, content binary, keep_id long, keep_row long, group_size long, text_sha256 string"


class ContentTable:
    """An open-addressing table (linear probing, doubling) from complete content to an entry number."""

    def __init__(self, most_bytes: int):
        self.most_bytes = most_bytes
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.n_bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def full(self, n_bytes: int) -> bool:
        return bool(self.contents) and self.n_bytes + n_bytes > self.most_bytes

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(entry, slot): the entry that holds exactly this content, or -1 and the free slot for it."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 17)) & mask
        while (e := int(self.slots[at])) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, at
            at = (at + 1) & mask
        return -1, at

    def add(self, slot: int, h: int, content: bytes) -> int:
        self.slots[slot] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.n_bytes += len(content) + 160
        if 2 * len(self.contents) > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, dtype=np.int64)
            mask = len(self.slots) - 1
            for k, x in enumerate(self.hashes):
                at = (x ^ (x >> 17)) & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k
        return e


def _batches(rows: list[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    size, part = 0, []
    for row in rows:
        part.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield _batch(part, schema)
            size, part = 0, []
    if part:
        yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


_LOCAL_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("content", pa.binary())])
_PASS_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("first_id", pa.int64()), ("first_row", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("content", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _order(first: tuple[int | None, int]) -> tuple[bool, int, int]:
    """The order of (doc_id, row): null doc_ids last."""
    return first[0] is None, first[0] or 0, first[1]


def _merge_own(table_bytes: int):
    """Rows of documents (n null) that point to a representative of their own task, and the representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        table, done = ContentTable(table_bytes), 0
        first: list[tuple[int | None, int]] = []  # of each entry the first (doc_id, row)
        count: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = ((*first[e], part, done + e, count[e], table.hashes[e], len(c), c) for e, c in enumerate(table.contents))
            yield from _batches(rows, _LOCAL_ARROW)

        for batch in batches:
            seqs = []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                content = squeezed(text.as_py() or b"")
                h = xxhash.xxh3_64_intdigest(content) >> 1
                e, slot = table.find(h, content)
                if e < 0:
                    if table.full(len(content)):
                        yield from flush()
                        done += len(table)
                        table.clear()
                        first, count = [], []
                        _, slot = table.find(h, content)
                    e = table.add(slot, h, content)
                    first.append((doc_id, row))
                    count.append(0)
                count[e] += 1
                first[e] = min(first[e], (doc_id, row), key=_order)
                seqs.append(done + e)
            n = len(seqs)
            if n:
                none = pa.nulls(n, pa.int64())
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([part] * n, pa.int32()), pa.array(seqs, pa.int64()), none, none, none, pa.nulls(n, pa.binary())], schema=_LOCAL_ARROW)
        yield from flush()

    return run


def _resolve(table_bytes: int):
    """One level: resolved representatives get keep_id, and what no longer fits stays with its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(table_bytes)
        groups: list[list] = []  # of each entry: first (doc_id, row), copies, representatives
        for batch in batches:
            part, seq, ids, rows, ns = (batch.column(k).to_pylist() for k in ("part", "seq", "first_id", "first_row", "n"))
            later = []
            for k, (h, content) in enumerate(zip(batch.column("h").to_pylist(), batch.column("content"), strict=True)):
                content = content.as_py()
                e, slot = table.find(h, content)
                if e < 0:
                    if table.full(len(content)):
                        later.append(k)
                        continue
                    e = table.add(slot, h, content)
                    groups.append([(ids[k], rows[k]), 0, []])
                g = groups[e]
                g[0] = min(g[0], (ids[k], rows[k]), key=_order)
                g[1] += ns[k]
                g[2].append((part[k], seq[k]))
            if later:
                rest = batch.take(pa.array(later, pa.int64()))
                n = len(later)
                none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
                yield pa.record_batch([rest.column(x).cast(_PASS_ARROW.field(x).type) for x in ("part", "seq", "first_id", "first_row", "n", "h", "n_bytes", "content")] + none, schema=_PASS_ARROW)
        out = ((p, s, None, None, None, None, None, None, *g[0], g[1], hashlib.sha256(table.contents[e]).hexdigest()) for e, g in enumerate(groups) for p, s in g[2])
        yield from _batches(out, _PASS_ARROW)

    return run


def _grouped(docs: DataFrame, row: Column, table_bytes: int) -> DataFrame:
    """doc_id, row, keep_id, keep_row, group_size, text_sha256 of every row; `row` is a number of its own."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", row.alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    local = written(rows.mapInArrow(_merge_own(table_bytes), _LOCAL), "exact-local")
    todo = local.where("n IS NOT NULL").withColumnsRenamed({"doc_id": "first_id", "row": "first_row"})
    done, level = [], 0
    while True:
        total = todo.agg(F.sum("n_bytes")).first()[0]
        if total is None:
            break
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // table_bytes))
        dealt = todo.select("part", "seq", "first_id", "first_row", "n", "h", "n_bytes", "content").repartition(buckets, F.xxhash64("h", F.lit(level)))
        passed = written(dealt.mapInArrow(_resolve(table_bytes), _PASS), f"exact-level{level}")
        done.append(passed.where("group_size IS NOT NULL").select("part", "seq", "keep_id", "keep_row", "group_size", "text_sha256"))
        todo = passed.where("group_size IS NULL")
        level += 1
    members = local.where("n IS NULL").select("doc_id", "row", F.col("part").alias("m_part"), F.col("seq").alias("m_seq"))
    if not done:
        return spark.createDataFrame([], "doc_id long, row long, keep_id long, keep_row long, group_size long, text_sha256 string")
    groups = done[0]
    for more in done[1:]:
        groups = groups.unionByName(more)
    out = members.join(groups, (F.col("m_part") == F.col("part")) & (F.col("m_seq") == F.col("seq")))
    return out.select("doc_id", "row", "keep_id", "keep_row", "group_size", "text_sha256")


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    out = _grouped(docs, F.monotonically_increasing_id(), table_bytes)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, one of each text, with the columns of the input, whatever their names."""
    docs, row = numbered(docs, "exact-rows")
    stays = _grouped(docs, F.col(row), table_bytes).where("row = keep_row").select("keep_row")
    return kept_rows(docs, row, stays)
