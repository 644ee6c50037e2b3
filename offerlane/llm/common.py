"""What the operators share: table readers, free column names, shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+ .
SPACE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df has not, whatever columns came with it."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    local one where that is unset and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='offerlane-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again.

    It cuts the lineage in a way that survives lost executors. The table goes
    when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame, name: str) -> None:
    """Removes the table that written(…, name) gave as df, before the application ends."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.rpartition("/")[2].startswith(f"{name}-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def reread(df: DataFrame, name: str) -> DataFrame:
    """df for work that reads it more than once and relies on the order of its rows:
    as it is if it is a plain scan, else (rows come out of a shuffle in any order)
    written first."""
    return written(df, name) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def numbered(df: DataFrame, row: str) -> DataFrame:
    """df, as reread() gives it, with a number per row."""
    return df.withColumn(row, F.monotonically_increasing_id())


def rows_by_number(picked: DataFrame, df: DataFrame, text: str):
    """picked (with row and tie: a row's number and the xxhash64 of its text) and its
    rows of df, as columns m.* and d.*, and a function that guards a column of text:
    a row that came with another's number stops the job."""
    (row,) = fresh(df, "row")
    joined = picked.alias("m").join(numbered(df, row).alias("d"), F.col("m.row") == F.col(f"d.`{row}`"), "left")
    same = F.xxhash64(F.col(f"d.`{text}`")) == F.col("m.tie")
    return joined, lambda body: F.when(same, body).otherwise(F.raise_error(F.lit("the rows of the input came in another order when they were read again")))
