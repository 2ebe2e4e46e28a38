"""Tables and files that steps leave in the shared folder for the next ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earmark.scale import cut_lineage, scratch_path, shared_dir


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; shuffle files of the finished job are let go."""
    out = cut_lineage(df)
    release(df.sparkSession)
    return out


def forget(df: DataFrame) -> None:
    """Delete the shared files behind tables of ``settle`` that ``df`` reads, once all that needs them is settled itself."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    shared = shared_dir(spark).rstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if shared.removeprefix("file:").lstrip("/") in folder and path.getName().startswith("step-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver has collected the plans that made them; ask for it now."""
    spark.sparkContext._jvm.System.gc()


def files_dir(spark: SparkSession, name: str) -> str:
    """A fresh shared folder for files that tasks write themselves."""
    return scratch_path(spark, name)


MOST_TASKS = 20_000


def file_tasks(manifest: DataFrame) -> int:
    """Tasks for the files of a manifest, one each up to ``MOST_TASKS``. The rows are small and the files behind them are
    not, so this number is never left to the size of the rows."""
    return max(1, min(manifest.count(), MOST_TASKS))


def spread_join(left: DataFrame, right: DataFrame, on: str, by: Column, salts: int = 16) -> DataFrame:
    """Inner join in which the ``left`` rows of one ``on`` are dealt over ``salts`` places by the hash of ``by``. ``right``
    has few rows, each is sent to all places."""
    many = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    few = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(few, [on, "_salt"]).drop("_salt")
