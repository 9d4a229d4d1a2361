"""Places of rows in an order, without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidejoin.sources.shared import staged


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with the place of each in its group, from 0, by the order; ties get places in any order.

    A range sort deals all rows over partitions, wherever their groups end; each is sorted by itself and
    begins where those before it end, by their counts. So a group that holds most rows is no hot spot.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *(F.col(c).asc_nulls_first() for c in group), *order)
    dealt = staged(dealt.withColumn("__part", F.spark_partition_id()), "sorted")
    inside = Window.partitionBy("__part", *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = dealt.groupBy("__part", *group).agg(F.count("*").alias("__n"))
    sizes = sizes.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__of_{c}") for c in group), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    met = dealt.withColumn(name, F.row_number().over(inside) - 1).join(sizes, same)
    return met.withColumn(name, (F.col(name) + F.col("__start")).cast("long")).select(*rows.columns, name)
