"""Folds of sorted rows, group by group, for what depends on the order of a group's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Records to a batch of output.
BATCH = 4000


def spread(df: DataFrame, mb: float) -> list[int]:
    """The number of partitions for an exchange of ``df``, to be given to ``repartition``, so that a task's share doesn't grow with the
    input: one for ``mb`` megabytes of the files read, if these are more than the session's number; nothing where the session's is enough."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    files = sum(s for s in sizes if s < 2**50)  # what isn't known counts as boundless
    wanted = min(-(-files // int(mb * 2**20)), 8192)
    return [wanted] if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def folded(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], schema: str, start: Callable[[], Callable[[tuple, Iterable[dict]], Iterator[dict]]], by: str = "ord") -> DataFrame:
    """The records that a fold makes of each group. Groups meet by a hash of their keys and are folded one after the other
    as their sorted rows stream by, so no group is held. ``start`` makes a task's fold, of a key and its rows."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            for row in zip(*found, strict=True):
                yield dict(zip(columns, row, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, made = start(), []
        for key, own in groupby(rows(batches), key=lambda r: tuple(r[k] for k in keys)):
            for record in fold(key, own):
                made.append(record)
                if len(made) >= BATCH:
                    yield pa.RecordBatch.from_pylist(made, arrow)
                    made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, by).select(*columns).mapInArrow(run, kind)
