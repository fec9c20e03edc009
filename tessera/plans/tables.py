"""Named graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.graph import PropertyGraph

#: Offsets that keep the ids of different tables apart.
OTHER = 1_000_000_000
NATION, CUSTOMER, SUPPLIER = 1_000, 1_000_000_000, 2_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with `place`, each line's number within its order (line numbers repeat in the data, so ties are broken by
    the other columns).  The window is pruned where place isn't used."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    return table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(w).cast("long"))


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """customer -> supplier for each line of an order, weighing its price; suppliers have no out-edges."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + OTHER).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    lines = _lines(spark, sf_dir).select("l_orderkey", (F.col("l_suppkey") + OTHER).alias("dst"), (F.col("l_orderkey") * 64 + F.col("place")).alias("eid"), F.col("l_extendedprice").alias("weight"), F.col("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return PropertyGraph(c.unionByName(s), lines.join(orders, "l_orderkey").select("src", "dst", "eid", "weight", "flag"))


def supply(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """supplier -> part for each line, weighing its quantity."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + OTHER).alias("id"), F.lit("part").alias("kind"))
    e = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + OTHER).alias("dst"), (F.col("l_orderkey") * 64 + F.col("place")).alias("eid"), F.col("l_quantity").alias("weight"))
    return PropertyGraph(s.unionByName(p), e)


def geo(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """customer and supplier -> nation -> region."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + NATION).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("n_regionkey").cast("long").alias("dst"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + CUSTOMER).alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), (F.col("c_nationkey") + NATION).cast("long").alias("dst"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), (F.col("s_nationkey") + NATION).cast("long").alias("dst"))
    low = n.unionByName(c).unionByName(s)
    e = low.select(F.col("id").alias("src"), "dst", F.col("id").alias("eid"), F.lit(1.0).alias("weight"))
    return PropertyGraph(r.unionByName(low.drop("dst")), e)


def copurchase(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """part -> part for two lines of one order, from the lower line number."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    own = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "place", "l_partkey")
    two = own.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("place").alias("q"), F.col("l_partkey").alias("dst"))
    e = own.join(two, "l_orderkey").where("l_linenumber < m").select(F.col("l_partkey").alias("src"), "dst", (F.col("l_orderkey") * 4096 + F.col("place") * 64 + F.col("q")).alias("eid"), F.lit(1.0).alias("weight"))
    return PropertyGraph(p, e)


def flow(spark: SparkSession, sf_dir: str, only: str | None = None) -> PropertyGraph:
    """user -> user of the next event in the order of (ts, event_id).

    Days are windows of their own and a small table of days links each day's last event to the next one's first,
    so no window holds all events.  only: condition on the edges' kind and next_kind, the types of the two events (the
    vertices stay all users)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").withColumn("day", F.to_date("ts"))
    users = events.select(F.col("user_id").alias("id")).distinct()
    w = W.partitionBy("day").orderBy("ts", "event_id")
    within = events.withColumn("x", F.lead(F.struct("user_id", "event_type")).over(w)).select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), F.col("event_type").alias("kind"), "x")
    order = F.struct("ts", "event_id")
    days = events.groupBy("day").agg(F.min(F.struct("ts", "event_id", "user_id", "event_type")).alias("first"), F.max(order).alias("last"))
    days = days.select("last.event_id", F.lead(F.struct("first.user_id", "first.event_type")).over(W.orderBy("day")).alias("next"))  # one row a day
    e = within.join(days, within.eid == days.event_id, "left").select("src", "eid", "kind", F.coalesce("x", "next").alias("x")).where("x is not null")
    e = e.select("src", F.col("x.user_id").alias("dst"), "eid", F.lit(1.0).alias("weight"), "kind", F.col("x.event_type").alias("next_kind"))
    if only:
        e = e.where(only)
    return PropertyGraph(users, e)


_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag) AS place FROM lineitem)"
# DuckDB definitions of the same graphs, for the oracles
SQL = {
    "trade": f"trade_v AS (SELECT c_custkey AS id, c_name AS name, 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey + {OTHER}, s_name, 'supplier', s_nationkey, s_acctbal FROM supplier), trade_e AS (SELECT o_custkey AS src, l_suppkey + {OTHER} AS dst, l_orderkey * 64 + place AS eid, l_extendedprice AS weight, l_returnflag AS flag FROM {_LINES} JOIN orders ON l_orderkey = o_orderkey)",
    "supply": f"supply_v AS (SELECT s_suppkey AS id, 'supplier' AS kind FROM supplier UNION ALL SELECT p_partkey + {OTHER}, 'part' FROM part), supply_e AS (SELECT l_suppkey AS src, l_partkey + {OTHER} AS dst, l_orderkey * 64 + place AS eid, l_quantity AS weight FROM {_LINES})",
    "geo": f"geo_l AS (SELECT n_nationkey + {NATION} AS id, n_name AS name, 'nation' AS kind, n_regionkey AS dst FROM nation UNION ALL SELECT c_custkey + {CUSTOMER}, c_name, 'customer', c_nationkey + {NATION} FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER}, s_name, 'supplier', s_nationkey + {NATION} FROM supplier), geo_v AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'region' AS kind FROM region UNION ALL SELECT CAST(id AS BIGINT), name, kind FROM geo_l), geo_e AS (SELECT CAST(id AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(id AS BIGINT) AS eid, 1.0 AS weight FROM geo_l)",
    "copurchase": f"copurchase_v AS (SELECT p_partkey AS id, p_brand AS brand FROM part), copurchase_e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, a.l_orderkey * 4096 + a.place * 64 + b.place AS eid, 1.0 AS weight FROM {_LINES} a JOIN {_LINES} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)",
    "flow": "flow_v AS (SELECT DISTINCT user_id AS id FROM events), flow_e AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_id AS eid, event_type AS kind, lead(event_type) OVER (ORDER BY ts, event_id) AS next_kind, 1.0 AS weight FROM events) WHERE dst IS NOT NULL)",
}
