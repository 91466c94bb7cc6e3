"""Versioned tables: two commits of a mart, each read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.entries.registry import query
from gaugeworks.entries.warehouse import load
from gaugeworks.session import scratch_path
from gaugeworks.sources import versions


@query(
    "versioned_replace",
    """with kept as (
         select 1 as version, * from lineitem where l_returnflag <> 'N'
         union all select 2, * from lineitem)
       select version, l_returnflag, count(*) as n, sum(l_orderkey) as order_sum, count(distinct l_partkey) as parts
       from kept group by all""",
)
def versioned_replace(spark, sf_dir):
    """The second version is the first one, as read back, and the rows that came later."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    root = scratch_path(spark, "versions")
    late = F.col("l_returnflag") == "N"
    first = versions.commit(spark, root, {"line": line.filter(~late)})
    grown = versions.read(spark, root, "line").unionByName(line.filter(late))
    second = versions.commit(spark, root, {"line": grown}, base=first)
    read = [
        versions.read(spark, root, "line", version).withColumn("version", F.lit(version)) for version in (first, second)
    ]
    return (
        read[0]
        .unionByName(read[1])
        .groupBy("version", "l_returnflag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_orderkey").alias("order_sum"),
            F.count_distinct("l_partkey").alias("parts"),
        )
    )
