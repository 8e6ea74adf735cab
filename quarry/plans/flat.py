"""One wide view of the order lines, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast("decimal(12,2)")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order, customer, nation, region and part. Only region and nation, which don't grow, are
    hinted for broadcast; unused columns and joins' columns are pruned by the optimizer."""
    read = lambda name: table(spark, sf_dir, name)
    places = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = (
        read("lineitem")
        .join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    sales = money("l_extendedprice") * (F.lit(1) - money("l_discount"))
    cost = money("l_quantity") * money("p_retailprice")
    return joined.select(
        F.col("o_orderdate").alias("order_date"), F.col("l_shipdate").alias("ship_date"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("customer"), F.col("p_brand").alias("brand"), F.col("p_type").alias("part_type"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), money("l_quantity").alias("quantity"),
        money("l_discount").alias("discount"), money("l_tax").alias("tax"), sales.alias("sales"), cost.alias("cost"), (sales - cost).alias("profit"),
    )


#: The same view for DuckDB, to stand after ``with``.
FLAT = """flat as (
  select *, sales - cost as profit from (
    select o_orderdate as order_date, l_shipdate as ship_date, r_name as region, n_name as nation, c_mktsegment as segment, c_name as customer,
      p_brand as brand, p_type as part_type, o_orderpriority as priority, o_orderstatus as status, cast(l_quantity as decimal(12,2)) as quantity,
      cast(l_discount as decimal(12,2)) as discount, cast(l_tax as decimal(12,2)) as tax,
      cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(12,2))) as sales,
      cast(l_quantity as decimal(12,2)) * cast(p_retailprice as decimal(12,2)) as cost
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey))"""
