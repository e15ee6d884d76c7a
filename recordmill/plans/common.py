"""Inputs shared by several queries, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.functions.dates import month_of
from recordmill.plans.registry import Tables

TARGET = "1-URGENT"
CATEGORIES = {
    "1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low", "unknown": "unknown",
}

# Members: orders in their customer's segment. Priority 4 is the unknown category; pending
# orders of January are undated.
MEMBERS_SQL = """
    select c_mktsegment as domain, o_custkey as group_id, o_orderkey as record_id,
           case when o_orderpriority = '4-NOT SPECIFIED' then 'unknown' else o_orderpriority end as category,
           case when o_orderstatus = 'P' and month(o_orderdate) = 1 then null
                else cast(date_trunc('month', o_orderdate) as date) end as ym,
           o_orderstatus as status, o_totalprice as price, year(o_orderdate) as yr
    from orders join customer on o_custkey = c_custkey"""

FIRST_SQL = f"""
    select domain, group_id, category, min(ym) as first_ym from ({MEMBERS_SQL})
    where ym is not null group by all"""


def members(t: Tables) -> DataFrame:
    undated = (F.col("o_orderstatus") == "P") & (F.month("o_orderdate") == 1)
    category = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise(
        F.col("o_orderpriority")
    )
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("domain"),
        F.col("o_custkey").alias("group_id"),
        F.col("o_orderkey").alias("record_id"),
        category.alias("category"),
        F.when(~undated, month_of("o_orderdate")).alias("ym"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.year("o_orderdate").alias("yr"),
    )


GROUP = ["domain", "group_id"]
