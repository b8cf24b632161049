"""Categorical record tables on top of the star-schema parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUST = ["region", "nation", "segment", "bal"]
LINE = ["flag", "status", "disc", "tax", "ship_year", "ship_qtr", "ship_half"]
PART = ["brand", "type", "size_band", "price_band"]
ORD = ["status", "priority", "year", "month"]
RUNS = ["run", "wave", "segment", "mixed"]
WIDE = [
    "region", "nation", "segment", "band5000", "band2000", "band1000", "band500", "digit0", "digit1", "digit2", "digit3",
    "mod2", "mod3", "mod5", "mod7", "mod11", "mod13", "block", "tens", "paid",
]
EVENTS = ["kind", "band", "k", "user"]
EVENT_CONTEXTS = {"kind": ["user"], "band": ["kind"], "k": ["kind", "band"], "user": []}
NUM3 = ["l_quantity", "l_extendedprice", "l_discount"]

CUST_CONTEXTS = {
    "region": ["nation"],
    "nation": ["region"],
    "segment": ["bal"],
    "bal": ["segment"],
}
LINE_CONTEXTS = {
    "flag": ["status"],
    "status": ["flag"],
    "disc": ["tax"],
    "tax": ["disc"],
    "ship_year": ["flag", "status"],
    "ship_qtr": ["ship_half"],
    "ship_half": ["ship_qtr"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int_token(c):
    return c.cast("bigint").cast("string")


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("c_custkey").alias("row_id"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            F.col("c_mktsegment").alias("segment"),
            _int_token(F.floor(F.col("c_acctbal") / 2000)).alias("bal"),
        )
    )


def cust_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cust(spark, sf_dir).withColumn(
        "segment", F.when(F.col("row_id") % 17 == 0, F.lit("")).otherwise(F.col("segment"))
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run`` has no token of more than three rows and decides ``wave``; ``mixed`` has rare and frequent tokens."""
    key = F.col("c_custkey")
    run = F.floor(key / 3)
    return table(spark, sf_dir, "customer").select(
        key.alias("row_id"),
        _int_token(run).alias("run"),
        _int_token(run % 10).alias("wave"),
        F.col("c_mktsegment").alias("segment"),
        F.when(key % 2 == 0, _int_token(F.col("c_nationkey"))).otherwise(_int_token(F.floor(key / 5))).alias("mixed"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty columns of a customer: names, bands and digits of the balance, residues of the key."""
    balance, key = F.floor(F.col("c_acctbal")), F.col("c_custkey")
    bands = [_int_token(F.floor(balance / w)).alias(f"band{w}") for w in (5000, 2000, 1000, 500)]
    digits = [_int_token(F.floor(F.abs(balance) / 10**k) % 10).alias(f"digit{k}") for k in range(4)]
    residues = [_int_token(key % m).alias(f"mod{m}") for m in (2, 3, 5, 7, 11, 13)]
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("row_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        *bands,
        *digits,
        *residues,
        _int_token(F.floor(key / 500)).alias("block"),
        _int_token(F.floor(key / 10) % 10).alias("tens"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.lit("paid")).alias("paid"),
    )


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: kind, bands of value and of the property k, residue of the user, and the time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        "ts",
        F.col("event_type").alias("kind"),
        _int_token(F.floor(F.col("value") / 10)).alias("band"),
        _int_token(F.floor(F.get_json_object("props", "$.k").cast("bigint") / 20)).alias("k"),
        _int_token(F.col("user_id") % 5).alias("user"),
    )


def line_id() -> Column:
    """(order, line number) repeats in these tables; with part, supplier and date it does not."""
    return F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").cast("string"))


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        line_id().alias("row_id"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        _int_token(F.round(F.col("l_discount") * 100)).alias("disc"),
        _int_token(F.round(F.col("l_tax") * 100)).alias("tax"),
        F.year(ship).cast("string").alias("ship_year"),
        F.quarter(ship).cast("string").alias("ship_qtr"),
        F.when(F.quarter(ship) <= 2, F.lit("1")).otherwise(F.lit("2")).alias("ship_half"),
    )


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        _int_token(F.floor(F.col("p_size") / 10)).alias("size_band"),
        _int_token(F.floor(F.col("p_retailprice") / 20)).alias("price_band"),
    )


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.month("o_orderdate").cast("string").alias("month"),
    )


def num3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        line_id().alias("row_id"),
        *NUM3,
    )
