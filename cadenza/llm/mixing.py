"""Mixing sources to target weights (problem 7): weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import cut, with_running_total


def normal_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))


def mix(items: DataFrame, id_col: str, source: Column, size: Column, targets: DataFrame, budget: int | None = None, seed: str = "mix", buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The mix (id, source, tokens, copy, finish, position) and the report of its shares per source.

    Documents of a source stand in the order of a seeded hash; copy k of a document ends at virtual time
    (k * tokens of the source + tokens up to and with it) / target share. All copies up to max_repeats are put into one
    range-wise order of that time and cut where their tokens would exceed ``budget`` (by default the tokens T of all
    documents of the targets' sources). runs_dry_at is the virtual time at which the last copy of a source ends: by time t a source that
    isn't dry has had t times its share, so one that runs dry before T can't reach its share of T (cannot_reach). Running totals are taken in ranges of the hash or the time, so a source with
    a third of all rows is many tasks' work. Documents of other or no sources are not in the mix; null or empty
    texts have size 0 and are drawn freely; rows count each, repeated or not; targets of share 0 or null draw
    nothing; an empty table gives an empty mix and a report of zeros. ``targets``: source, target_share, max_repeats.
    """
    t = targets.select(F.col("source").alias("target"), normal_source(F.col("source")).alias("src"), F.coalesce("target_share", F.lit(0.0)).cast("double").alias("share"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("repeats")).where("src is not null")
    d = items.select(F.col(id_col).alias("id"), normal_source(source).alias("src"), F.coalesce(size, F.lit(0)).cast("bigint").alias("tokens"))
    d = d.join(t.select("src"), "src", "left_semi")
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), F.col("tokens").cast("string")), 256)
    d = d.withColumn("h", h)
    place = F.floor(F.conv(F.substring("h", 1, 7), 16, 10).cast("bigint") * buckets / F.lit(1 << 28)).cast("int")
    d = cut(with_running_total(d, ["src"], place, [F.col("h"), F.col("id")], F.col("tokens"), "before"))
    own = d.groupBy("src").agg(F.sum("tokens").alias("own"), F.count(F.lit(1)).alias("documents"))
    stats = cut(t.join(own, "src", "left").fillna(0, ["own", "documents"]))
    total = stats.agg(F.sum("own")).first()[0] or 0
    budget = total if budget is None else budget
    sources = stats.where("share > 0 and repeats > 0").select("src", "share", "repeats", "own")
    copies = d.join(sources, "src").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    copies = copies.withColumn("finish", (F.col("copy") * F.col("own") + F.col("before") + F.col("tokens")) / F.col("share"))
    # Beyond budget / least share nothing can be drawn; ranges of equal width hold about equally many tokens until sources run out.
    last = sources.agg(F.max(F.col("own") * F.col("repeats") / F.col("share"))).first()[0] or 1.0
    horizon = max(min(last, budget / (sources.where("own > 0").agg(F.min("share")).first()[0] or 1.0)), 1.0)
    bucket = F.least(F.floor(F.col("finish") / horizon * buckets), F.lit(buckets)).cast("int")
    out = with_running_total(copies, [], bucket, [F.col("finish"), F.col("src"), F.col("id"), F.col("copy"), F.col("before")], F.col("tokens"), "position").where(F.col("position") + F.col("tokens") <= budget)
    out = out.select("id", "src", "tokens", "copy", "finish", "position")
    got = out.groupBy("src").agg(F.sum("tokens").alias("drawn"), F.count(F.lit(1)).alias("drawn_documents"), F.max("copy").alias("last_copy"))
    dry = copies.groupBy("src").agg(F.max("finish").alias("dry"))
    r = stats.join(got, "src", "left").join(dry, "src", "left").fillna(0, ["drawn", "drawn_documents", "dry"])
    report = r.select(
        F.col("target").alias("source"), F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("own").alias("available_tokens"), "documents", F.col("drawn").alias("drawn_tokens"), "drawn_documents",
        (F.coalesce("last_copy", F.lit(-1)) + 1).alias("passes"), (F.col("drawn") / F.lit(float(max(budget, 1)))).alias("actual_share"), F.col("dry").alias("runs_dry_at"), ((F.col("share") > 0) & (F.col("dry") < F.lit(total))).alias("cannot_reach"),
    )
    return out.withColumnRenamed("src", "source"), report
