"""End-to-end example: clean, join, filter, summarise, sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.aggregates import group_summary
from assayloom.operators.cleaning import clean_cells, filter_rows
from assayloom.operators.joins import join_tables
from assayloom.plans.registry import Tables, query

SUMMARY = ("count", "sum", "mean", "median", "sd")


def segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(Tables(spark, folder)).orderBy(F.desc("o_totalprice_sum"))


@query(
    "flagship_segment_summary",
    """SELECT c_mktsegment, count(*) AS row_count, count(o_totalprice) AS o_totalprice_count,
      round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 4) AS o_totalprice_mean,
      round(quantile_cont(o_totalprice, 0.5), 4) AS o_totalprice_median, round(stddev_samp(o_totalprice), 4) AS o_totalprice_sd
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1""",
)
def _segments(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_totalprice", "o_orderpriority")
    customers = clean_cells(
        t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], missing_values=["NA"]
    )
    joined = join_tables(orders, customers, ["o_custkey"], ["c_custkey"], "left")
    kept = filter_rows(joined, [("o_totalprice", "gt", 1000)])
    out = group_summary(kept, ["c_mktsegment"], ["o_totalprice"], SUMMARY, digits=4)
    return out.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))
