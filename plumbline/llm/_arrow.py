"""Columns computed from texts by Python workers, a bounded part of a batch at a time.

The module travels to the executors by value, so the driver's helpers are imported where they are
used: a worker needs none of this package.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm import _words as W


def filled(column):
    """A text column without nulls: they count as the empty text."""
    return column.fill_null("") if column.null_count else column


def extend(df: DataFrame, text: str, fields: StructType, compute, limit: int = 4 << 20) -> DataFrame:
    """``df`` with the columns ``fields`` that ``compute(part)`` returns as Arrow arrays.

    ``part`` is a record batch whose column ``text`` holds no null. Columns of ``df`` named as
    one of ``fields`` are replaced; all others, the text included, pass through.
    """
    from plumbline.llm import _runtime as R

    R.small_batches(df.sparkSession)
    names = {n.lower() for n in fields.fieldNames()}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = StructType(base.schema.fields + fields.fields)
    at = base.columns.index(text)

    def run(batches):
        for batch in batches:
            full = batch.set_column(at, text, filled(batch.column(at)))
            done = 0
            for part in W.slices(full, text, limit):
                new = compute(part)
                kept = batch.slice(done, part.num_rows)
                done += part.num_rows
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=schema.fieldNames())

    return base.mapInArrow(run, schema)


def reduced(df: DataFrame, text: str, schema: str, start, step, finish) -> DataFrame:
    """Rows ``finish(state)`` of each partition, after ``step(state, part)`` for its parts."""
    from plumbline.llm import _runtime as R

    R.small_batches(df.sparkSession)

    def run(batches):
        state = start()
        for batch in batches:
            full = batch.set_column(batch.schema.get_field_index(text), text, filled(batch.column(text)))
            for part in W.slices(full, text):
                step(state, part)
        yield from finish(state)

    return df.mapInArrow(run, schema)


register_pickle_by_value(sys.modules[__name__])
