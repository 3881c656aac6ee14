"""Collections and key spaces made of the test tables, each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: an object, an array that may be empty or missing, and an optional text."""
    k = F.col("o_orderkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    tags = F.when(k % 9 == 0, F.expr("cast(array() as array<string>)")).when(k % 5 == 0, F.lit(None)).otherwise(F.array(text("t", k % 4), text("t", (k + 1) % 4)))
    return table(spark, sf_dir, "orders").select(
        k.alias("_id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("priority"),
        F.struct((k % 3).alias("x"), text("y", k % 4).alias("y")).alias("sub"), tags.alias("tags"), F.when(k % 3 == 0, text("o", k % 2)).alias("opt"),
    )


ORDER_DOCS = """(select o_orderkey as _id, o_custkey as cust, o_orderstatus as status, o_totalprice as total, o_orderdate as date, o_orderpriority as priority,
  {'x': o_orderkey % 3, 'y': 'y' || (o_orderkey % 4)} as sub,
  case when o_orderkey % 9 = 0 then []::varchar[] when o_orderkey % 5 = 0 then null else ['t' || (o_orderkey % 4), 't' || ((o_orderkey + 1) % 4)] end as tags,
  case when o_orderkey % 3 = 0 then 'o' || (o_orderkey % 2) end as opt from orders)"""


def item_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as an array of documents, by line number."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")))).alias("items")
    )
    return items


ITEM_DOCS = "(select l_orderkey as _id, list({'line': l_linenumber, 'qty': l_quantity, 'part': l_partkey, 'flag': l_returnflag} order by l_linenumber, l_quantity, l_partkey, l_returnflag) as items from lineitem group by l_orderkey)"


def place_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a GeoJSON point."""
    k = F.col("c_custkey")
    lon, lat = (k * 7919 % 36000) / F.lit(100.0) - 180, (k * 104729 % 17000) / F.lit(100.0) - 85
    return table(spark, sf_dir, "customer").select(k.alias("_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("loc"))


PLACE_DOCS = "(select c_custkey as _id, c_name as name, c_mktsegment as segment, (c_custkey * 7919 % 36000) / 100.0::double - 180 as lon, (c_custkey * 104729 % 17000) / 100.0::double - 85 as lat from customer)"


NOW_MS = 1_704_067_200_000  # 2024-01-01, a fixed clock


def key_space(spark: SparkSession, sf_dir: str):
    """Sets and scored sets of users by event type, lists of roles by conversation, hashes by customer, texts by
    document; places of customers; and events as keys with expiry in database 1."""
    from tessera.operators.kv import KeySpace

    db = F.lit(0).alias("db")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("key")
    events = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string").alias("member")
    sets = events.select(db, text("S:", "event_type"), user).distinct()
    scores = events.groupBy(text("Z:", "event_type"), user).agg(F.max("value").alias("score")).withColumn("db", F.lit(0))
    customer = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lon, lat = (k * 7919 % 36000) / F.lit(100.0) - 180, (k * 104729 % 17000) / F.lit(100.0) - 85
    from tessera.functions import geohash

    places = customer.select(F.lit("G:places").alias("key"), F.col("c_name").alias("member"), geohash.encode(lon, lat).cast("double").alias("score"), db)
    fields = customer.select(text("H:", "c_custkey"), F.expr("stack(3, 'name', c_name, 'nation', cast(c_nationkey as string), 'segment', c_mktsegment) as (field, value)"), db)
    lists = table(spark, sf_dir, "conversations").select(db, text("L:", "conv_id"), F.col("turn").alias("idx"), F.col("role").alias("value"))
    strings = table(spark, sf_dir, "documents").select(db, text("D:", "doc_id"), F.lit("string").alias("type"), F.lit(0).alias("expire_ms"), F.col("text").alias("payload"))
    e = F.col("event_id")
    expiring = table(spark, sf_dir, "events").select(
        F.lit(1).alias("db"), text("E:", "event_id"), F.when(e % 5 == 0, "hash").when(e % 5 == 1, "zset").otherwise("string").alias("type"),
        F.when(e % 4 == 0, F.lit(0)).otherwise(F.unix_millis(F.col("ts").cast("timestamp")) + e % 3 * 3600000).alias("expire_ms"), F.lit("x").alias("payload"),
    )
    return KeySpace.of(spark, NOW_MS, set=sets, zset=scores.unionByName(places), hash=fields, list=lists, meta=strings.unionByName(expiring))


SETS = "(select distinct 'S:' || event_type as key, cast(user_id as varchar) as member from events)"
SCORES = "(select 'Z:' || event_type as key, cast(user_id as varchar) as member, max(value) as score from events group by 1, 2)"
LISTS = "(select 'L:' || conv_id as key, turn as idx, role as value from conversations)"
EXPIRING = "(select 'E:' || event_id as key, case when event_id % 5 = 0 then 'hash' when event_id % 5 = 1 then 'zset' else 'string' end as type, case when event_id % 4 = 0 then 0 else cast(floor(epoch_us(ts) / 1000) as bigint) + event_id % 3 * 3600000 end as expire_ms from events)"
