"""Small sets stay with the driver, large ones go to the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: rows up to which a set is kept as a local relation
LOCAL_ROWS = 10_000
#: bytes of its tables from which a plan is run once and written, whatever the size of its result
SMALL_INPUT = 32 << 20


class Lazy(dict):
    """Tables by name, each made when it is first asked for: what a request doesn't read costs nothing."""

    def __init__(self, make: "dict[str, Callable[[], DataFrame]]"):
        super().__init__()
        self.make = make

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.make[name]()
        return self[name]

    def __contains__(self, name: object) -> bool:
        return name in self.make


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, the checkpoint folder of the context, or a temporary one on a local master.

    A cluster without either is an error: a folder of the driver's machine would be lost to the executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanforge-"))
    return sc.getCheckpointDir()


def session_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; the JVM deletes it when it ends."""
    sc = spark.sparkContext
    at = f"{shared_dir(spark)}/spanforge-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the session's folder that nothing uses yet."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, at: str) -> None:
    """Delete a folder of this session that nobody reads any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` computed once into a table of the shared folder: its lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    at = fresh_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def local(spark: SparkSession, table, schema: "str | T.StructType") -> DataFrame:
    """A local relation from an Arrow table or a list of tuples."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not isinstance(table, pa.Table):
        columns = list(zip(*table)) if table else [[] for _ in kind]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(kind))], kind.names)
    return spark.createDataFrame(table, kind)


def _read(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as its optimizer knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def settle_rows(df: DataFrame, limit: int = LOCAL_ROWS) -> tuple[DataFrame, int, "object | None"]:
    """``settle``, and the rows themselves (an Arrow table) where the driver keeps them."""
    if _read(df) > SMALL_INPUT:  # to look whether it is small would be to work it out twice
        kept = written(df, "set")
        n = kept.count()
        if n > limit:
            return kept, n, None
        head = kept.toArrow()
        return local(df.sparkSession, head, df.schema), n, head
    head = df.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        return local(df.sparkSession, head, df.schema), head.num_rows, head
    kept = written(df, "set")
    return kept, kept.count(), None


def settle(df: DataFrame, limit: int = LOCAL_ROWS) -> tuple[DataFrame, int]:
    """The same rows without their lineage, and their number: computed once into a table of the shared folder.

    Up to ``limit`` rows are kept as a local relation instead.
    """
    return settle_rows(df, limit)[:2]
