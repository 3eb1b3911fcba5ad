"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new one of this machine.

    Without that setting the session must be local, as no other machine could
    read the folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='keyrill-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    Lineage ends there: an executor that is lost later costs no recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that cut() made and nothing will read again."""
    spark, path = df.sparkSession, df.shared_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns under our own names; other columns can't clash with them."""
    return df.select(*[df[quoted(c)].alias(name) for name, c in wanted.items()])


def map_rows(rows: DataFrame, each: Callable, added: list[StructField]) -> DataFrame:
    """rows.mapInArrow(each) for columns of any names, dots included; each adds columns at the end."""
    names, new = rows.columns, [f.name for f in added]
    safe = rows.toDF(*[f"c{i}" for i in range(len(names))])
    own = safe.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[*own, *new])

    return safe.mapInArrow(run, StructType([*safe.schema.fields, *added])).toDF(*names, *new)


def quoted(name: str) -> str:
    """A column's name for Spark, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"
