"""Groups as streams of Arrow batches: work that may fail, and folds in order, with bounded memory for a group of any size."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Batches = Iterator[pa.RecordBatch]


def _in_order(df: DataFrame, keys: list[str], order: list[str]):
    """Groups whose rows come in order: the sort by keys and order also serves the grouping."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).groupBy(*keys)


def process_groups(df: DataFrame, keys: list[str], order: list[str], item: str, work: Callable[[tuple, Batches], Batches], outputs: str) -> DataFrame:
    """keys, item, status, error and the outputs of each item, by running `work` once for each group.

    work(key values, batches in order) yields batches with `item`, perhaps `status` (done or skipped),
    and columns of `outputs` (a schema). When it ends, items that it has not reported are done, with
    null outputs; when it raises, they are failed, with the error, and what it has reported stays. The
    rest of a failing group is only counted, never held. Of a group no more than a batch is in memory,
    besides the names of items not reported yet.
    """
    kinds = T.StructType.fromDDL(outputs)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("item", df.schema[item].dataType), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *kinds])
    arrow = to_arrow_schema(schema)

    def rows(key: tuple, items: pa.Array, status, error: str | None = None, made: pa.RecordBatch | None = None) -> pa.RecordBatch:
        n = len(items)
        own = [pa.array([k.as_py()] * n, arrow.field(i).type) for i, k in enumerate(key)]
        status = status if isinstance(status, pa.Array) else pa.array([status] * n, pa.string())
        names = [] if made is None else made.schema.names
        more = [made.column(f.name).cast(arrow.field(f.name).type) if f.name in names else pa.nulls(n, arrow.field(f.name).type) for f in kinds]
        return pa.record_batch([*own, items, status, pa.array([error] * n, pa.string()), *more], schema=arrow)

    def run(key: tuple, batches: Batches) -> Batches:
        pending: dict = {}
        kind = arrow.field("item").type

        def seen() -> Batches:
            for batch in batches:
                pending.update(dict.fromkeys(batch.column(item).to_pylist()))
                yield batch

        source, error = seen(), None
        made = work(tuple(k.as_py() for k in key), source)
        while True:
            try:
                out = next(made, None)
            except Exception as e:  # noqa: BLE001  whatever the work raises is the group's failure
                error = f"{type(e).__name__}: {e}\n{traceback.format_exc(limit=-2)}"
                break
            if out is None:
                break
            items = out.column("item").cast(kind)
            for x in items.to_pylist():
                pending.pop(x, None)
            yield rows(key, items, out.column("status").cast(pa.string()) if "status" in out.schema.names else "done", None, out)
        status = "done" if error is None else "failed"
        if pending:
            yield rows(key, pa.array(list(pending), kind), status, error)
            pending.clear()
        for batch in batches:  # what the work hasn't read
            yield rows(key, batch.column(item), status, error)

    return _in_order(df, keys, order).applyInArrow(run, schema)


def ordered_fold(df: DataFrame, keys: list[str], order: str, step: Callable, schema: str) -> DataFrame:
    """step(state, row) -> (state, output dict) over each group's rows in order; the outputs as rows, batch by batch."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(key: tuple, batches: Batches) -> Batches:
        state, own = None, dict(zip(keys, (k.as_py() for k in key), strict=True))
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, made = step(state, row)
                out.append({**own, **made})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _in_order(df, keys, [order]).applyInArrow(run, schema)
