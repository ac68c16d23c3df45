"""Session helpers: intermediate tables on shared storage and size-checked reads of small tables."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

FOLDER = "spark.checkpoint.dir"


def stage_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, from ``spark.checkpoint.dir``.

    Only a local session (``local[n]``, as in tests) may leave it unset; it then gets a
    temporary folder, since there all tasks run on this machine.
    """
    folder = spark.conf.get(FOLDER, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {FOLDER} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set(FOLDER, folder)
    return folder


def hold(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder once; later steps read it, column by column.

    The rows survive lost executors, and numbers derived from partitions cannot change when a
    task is run again. ``release`` deletes the files when their readers are done.
    """
    path = f"{stage_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of held tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_stage_path", None)
        if path:
            session = df.sparkSession
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fixed_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of the rows given, made without Python tasks.

    Rows that are not Arrow are sent by Python workers of another kind than those of the
    operators, and each executor would keep both kinds side by side.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    fields = T.StructType.fromDDL(ddl).fields
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=[f.name for f in fields]), schema=ddl)


def small_rows(df: DataFrame, limit: int = 20_000) -> list:
    """Rows of a configuration table; refuses tables that are not small."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"expected a small table, got more than {limit} rows")
    return rows
