"""The canonical cohort over events, for Spark and as a common table expression for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import table


def cohort(spark: SparkSession, d: str) -> DataFrame:
    """One row per event: id, label, source_group, role, group_id, component_id, k, ts, user_id, value, f1..f5, score.

    Groups cross sources only for every fifth user; every 25th user shares a component with the next one.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.col("event_type").isin("error", "purchase").cast("int")
    own = F.concat_ws("#", "event_type", F.col("user_id").cast("string"))
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("source_group"), "value", k.alias("k"), label.alias("label"), F.when(F.col("user_id") % 5 == 0, F.col("user_id").cast("string")).otherwise(own).alias("group_id"), F.when(F.col("user_id") % 10 == 9, "locked").otherwise("development").alias("role"))
    e = e.withColumn("component_id", F.when(F.col("user_id") % 25 == 0, F.concat(F.lit("pair:"), F.col("user_id").cast("string"))).when(F.col("user_id") % 25 == 1, F.concat(F.lit("pair:"), (F.col("user_id") - 1).cast("string"))).otherwise(F.col("group_id")))
    return e.select(
        "*", F.col("value").alias("f1"), F.when(F.col("k") % 7 != 0, F.col("k") / 100).alias("f2"), F.hour("ts").cast("double").alias("f3"), ((F.col("id") % 97) / 10).alias("f4"), F.when(F.col("k") % 3 != 0, F.col("value") * (F.col("k") % 3)).alias("f5"),
        (((F.col("id") * 37 + F.col("k") * 101 + F.col("label") * 250) % 1000) / 1000).alias("score"),
    )


#: The same, as a common table expression named c.
C = """c0 as (select event_id as id, ts, user_id, event_type as source_group, value, cast(json_extract(props, '$.k') as int) as k,
  case when event_type in ('error', 'purchase') then 1 else 0 end as label,
  case when user_id % 5 = 0 then cast(user_id as varchar) else event_type || '#' || cast(user_id as varchar) end as group_id,
  case when user_id % 10 = 9 then 'locked' else 'development' end as role from events),
c as (select *, case when user_id % 25 = 0 then 'pair:' || cast(user_id as varchar) when user_id % 25 = 1 then 'pair:' || cast(user_id - 1 as varchar) else group_id end as component_id,
  value as f1, case when k % 7 <> 0 then k / 100.0::double end as f2, cast(hour(ts) as double) as f3, (id % 97) / 10.0::double as f4, case when k % 3 <> 0 then value * (k % 3) end as f5,
  ((id * 37 + k * 101 + label * 250) % 1000) / 1000.0::double as score from c0)"""
