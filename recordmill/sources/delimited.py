"""Line-oriented multi-line containers: header-delimited texts and group listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.text import SPACE


def write_records(df: DataFrame, path: str, id_col: str, tag: Column, body: Column) -> None:
    """One ``>id|tag`` header line per record, then the body lines.

    A body line that starts with ``>`` gets a space in front; the reader trims lines.
    """
    safe = F.regexp_replace(body, "(^|\\n)>", "$1 >")
    df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("|"), tag, F.lit("\n"), safe)).write.text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(id, tag, body)``; body lines are trimmed and joined without a separator.

    The record delimiter is the line separator of the scan, so files split anywhere and no
    record passes through more than one task.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    rec = F.regexp_replace("value", "^>", "")
    head = F.split_part(rec, F.lit("\n"), F.lit(1))
    body = F.regexp_replace(rec, "^[^\\n]*(\\n|$)", "")
    trimmed = F.transform(
        F.split(body, "\n"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")
    )
    return raw.where(F.length("value") > 0).select(
        F.trim(F.split_part(head, F.lit("|"), F.lit(1))).alias("id"),
        F.trim(F.split_part(head, F.lit("|"), F.lit(2))).alias("tag"),
        F.array_join(trimmed, "").alias("body"),
    )


def write_listing(members: DataFrame, path: str) -> None:
    """Write ``(group, pos, size, member, is_representative)`` as a group listing.

    ``>Group g`` is followed by ``pos<TAB>size, >member... *`` for the representative and
    ``at p%`` otherwise. A group that spans several files repeats its header in each.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.repartitionByRange(n, "group", "pos").withColumn("__f", F.spark_partition_id())
    first = F.row_number().over(W.partitionBy("__f", "group").orderBy("pos")) == 1
    line = F.concat(
        F.col("pos"), F.lit("\t"), F.col("size"), F.lit("u, >"), F.col("member"), F.lit("... "),
        F.when(F.col("is_representative"), "*").otherwise("at 99.00%"),
    )
    header = F.concat(F.lit(">Group "), F.col("group"), F.lit("\n"))
    out = rows.withColumn("__line", F.concat(F.when(first, header).otherwise(""), line))
    out.sortWithinPartitions("__f", "group", "pos").select(F.col("__line").alias("value")).write.text(path)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """``(member, group, size, is_representative)`` from a group listing.

    The group of a line is the last header above it. Headers are carried forward inside each
    file block first; the last header of the earlier blocks fills the top of a block. So a
    group of any size is read by as many tasks as its lines have blocks.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    head = F.nullif(F.regexp_extract("value", "^>Group +(\\S+)", 1), F.lit(""))
    lines = lines.withColumn("head", head)
    inside = W.partitionBy("file", "block").orderBy("line")
    lines = lines.withColumn("own", F.last("head", ignorenulls=True).over(inside))
    ends = lines.groupBy("file", "block").agg(
        F.max_by("head", F.when(F.col("head").isNotNull(), F.col("line"))).alias("end_head")
    )
    above = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(
        "file", "block", F.last("end_head", ignorenulls=True).over(above).alias("above")
    )
    member = F.regexp_extract("value", ">(.+?)\\.\\.\\.", 1)
    return (
        lines.where(F.col("head").isNull() & F.col("value").contains("..."))
        .join(carry, ["file", "block"])
        .select(
            member.alias("member"),
            F.coalesce("own", "above").alias("group"),
            F.regexp_extract("value", "\\t(\\d+)u", 1).cast("bigint").alias("size"),
            F.rtrim("value").endswith("*").alias("is_representative"),
        )
    )
