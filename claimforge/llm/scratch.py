"""Tables that cut a plan: written to the folder which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where it is unset and the master is local (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='claimforge-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a lost executor costs no recomputation before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def cut_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """As ``cut``, in as many buckets by ``column`` as a shuffle has partitions: a later group or join by it reads its
    rows where they lie, and only the other side is shuffled."""
    spark = df.sparkSession
    table = f"claimforge_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", f"{shared_dir(spark)}/claimforge/{name}-{table}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay
    return out


def free(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
