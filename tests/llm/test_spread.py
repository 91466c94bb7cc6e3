"""Equal keys must not meet in one task, and shards must not share one."""

from pyspark.sql import functions as F

from gaugeworks.llm import mixing, packing


def test_pieces_without_an_id_are_dealt_evenly(spark):
    rows = spark.range(6000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"),
        F.lit(9).cast("long").alias("ids_crc32"), F.lit(700).cast("long").alias("doc_tokens"),
    )
    packed = packing.pack(rows, group_pieces=300)
    groups = packed.groupBy(F.floor(F.col("sequence_id") / packing.GROUP_STRIDE).alias("g")).count().collect()
    assert len(groups) == 20 and max(r["count"] for r in groups) < 450
    filled = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("places"))
    assert filled.filter("n > 5 or n <> places").count() == 0 and packed.count() == 6000


def test_each_shard_is_one_partition(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source")
    )
    mix = mixing.plan_mix(docs, shard_words=700)
    assert mix.shards > 8
    got = mixing.mixed(docs, mix)
    assert got.rdd.getNumPartitions() == mix.shards
    per_shard = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_shard) == mix.draws.select("shard").distinct().count()
