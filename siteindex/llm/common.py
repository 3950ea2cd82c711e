"""What several of these operators need."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteindex.session import shared_dir

#: The characters that end a word or frame a line: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id wherever rows are grouped, joined or sorted by it: nulls come first.
NO_ID = -(1 << 63)
KEY, VERSION = "_key", "_version"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in the cluster's shared folder.

    It cuts the lineage, outlives executors and is read again by columns.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what ``written`` made, once all that was read from it is written itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def id_key(doc_id: str = "doc_id") -> Column:
    """The id without nulls."""
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))


def id_of(key: str = KEY) -> Column:
    return F.nullif(F.col(key), F.lit(NO_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole text, with an id key and a version that tells texts of one id apart.

    Rows equal in both are one document stored more than once.
    """
    return docs.select(
        "doc_id",
        whole_text().alias("text"),
        id_key().alias(KEY),
        F.xxhash64(whole_text()).alias(VERSION),
    )


def ranked(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str | Column], name: str
) -> DataFrame:
    """Position of each row in its group from 0, by ``block`` and then ``order``, as a bigint.

    Only the rows of a block meet in a task; the counts of the earlier blocks, one row for
    each block, give the rest. ``df`` is read twice: pass a written table.
    """
    sizes = df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        *group, block, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    inner = Window.partitionBy(*group, block).orderBy(*order)
    return (
        df.withColumn("_in_block", F.row_number().over(inner))
        .join(before, [*group, block])
        .withColumn(name, F.col("_before") + F.col("_in_block") - 1)
        .drop("_before", "_in_block")
    )
