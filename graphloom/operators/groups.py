"""Work on groups that is a sequence of choices, with many small groups in one stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a task hands back at a time.
ROWS_BACK = 8192


def values_of(column) -> list:
    """An Arrow array as a list, as to_pylist gives it, without a scalar object for each value."""
    import pyarrow.types as of

    kind = column.type
    if of.is_string(kind) or of.is_boolean(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if of.is_integer(kind) or of.is_float64(kind):
        if not column.null_count:
            return column.to_numpy(zero_copy_only=False).tolist()
        return [x if ok else None for x, ok in zip(column.fill_null(0).to_numpy(zero_copy_only=False).tolist(), column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    if of.is_list(kind):
        ends, each = column.offsets.to_pylist(), values_of(column.values)
        return [each[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=False)]
    return column.to_pylist()


def each_group(rows: DataFrame, key: str, work: Callable[[list[tuple]], Iterable[tuple]], schema: str, order: list[Column] | None = None) -> DataFrame:
    """What work returns for the rows of each key, as tuples in the order of rows' columns, sorted by order.

    Rows come sorted by key, so a task holds one group at a time, and a group costs no frame of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    at, fields = rows.columns.index(key), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        out, held, now = [], [], None

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            for row in zip(*map(values_of, batch.columns), strict=True):
                if held and row[at] != now:
                    out.extend(work(held))
                    held = []
                    if len(out) >= ROWS_BACK:
                        yield packed()
                        out = []
                now = row[at]
                held.append(row)
        if held:
            out.extend(work(held))
        if out:
            yield packed()

    return rows.repartition(F.col(key)).sortWithinPartitions(F.col(key), *(order or [])).mapInArrow(run, schema)
