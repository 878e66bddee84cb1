"""Row-for-row Python work on texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TEXT = "_text"


def map_texts(
    docs: DataFrame,
    keep: dict[str, Column],
    text: Column,
    setup: Callable[[], Callable[[list[str]], list[list]]],
    fields: T.StructType,
) -> DataFrame:
    """The columns of ``keep`` beside one row of ``fields`` for each text.

    ``setup`` runs once in each task and returns the function that turns a list
    of texts (null read as empty) into one list of values for each field. Rows
    stay in their partition, so there is no shuffle and nothing to collect.
    """
    rows = docs.select(
        *[c.alias(name) for name, c in keep.items()], F.coalesce(text, F.lit("")).alias(TEXT)
    )
    kept = T.StructType([rows.schema[name] for name in keep])
    schema = T.StructType([*kept.fields, *fields.fields])
    arrow, n_kept = to_arrow_schema(schema), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            made = work(batch.column(batch.num_columns - 1).to_pylist())
            columns = [
                *(batch.column(i).cast(arrow.field(i).type) for i in range(n_kept)),
                *(
                    pa.array(values, type=arrow.field(n_kept + i).type)
                    for i, values in enumerate(made)
                ),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return rows.mapInArrow(run, schema)
