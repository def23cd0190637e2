"""Sequential rules over sorted groups: one streaming pass, whatever a group's size."""

from __future__ import annotations

from collections.abc import Callable, Sequence, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scanned(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], uses: Sequence[str], name: str, kind: str, start: Callable[[], Any], step: Callable[..., tuple[Any, Any]]) -> DataFrame:
    """rows with a column `name`: what step(state, *uses) -> (state, value) gives for each row of its group, in
    order. The state is all that is held, so a group that fills a task costs time there but no memory."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])
    types = to_arrow_schema(schema)
    n = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*group, *uses)]
            out = []
            for row in zip(*columns, strict=True):
                if row[:n] != key:
                    key, state = row[:n], start()
                state, value = step(state, *row[n:])
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, types.field(len(types) - 1).type)], schema=types)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
