"""What the operators of this subpackage share: tables, written tables in the shared folder, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of an Arrow map holds at a time (a longer text is a step of its own).
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where neither the session nor its context has one, and all runs on this machine (tests, a laptop), is a temporary folder
    made; on a cluster each machine would have its own, so there it raises.
    """
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives a lost executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (in any case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut into pieces of about ``most`` bytes of text, and their texts (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        n, at = batch.num_rows, 0
        sizes = [0 if x is None else x for x in pc.binary_length(column).to_pylist()]
        while at < n:
            end, held = at + 1, sizes[at]
            while end < n and held + sizes[end] <= most:
                held += sizes[end]
                end += 1
            piece = batch.slice(at, end - at)
            yield piece, ["" if x is None else x for x in column.slice(at, end - at).to_pylist()]
            at = end


def map_text(df: DataFrame, text: str, fields: dict[str, str], fn: Callable[[list[str]], list[list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns that ``fn`` makes from lists of whole texts, in Arrow batches.

    ``fields`` names the new columns and their SQL types. Columns of ``df`` of the same name are
    replaced, columns in ``drop`` don't come back, all others pass unchanged.
    """
    new = T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])
    keep = [f for f in df.schema.fields if f.name not in fields and f.name not in drop]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    names = [f.name for f in keep] + list(fields)
    kept = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in steps(batches, text):
            made = [pa.array(c, k) for c, k in zip(fn(texts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)) for c in kept] + made, names)

    return df.mapInArrow(run, T.StructType(keep + new.fields))
