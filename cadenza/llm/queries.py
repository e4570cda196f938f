"""The problems' queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import abuse, dyadic, mixing, overlap, packing, splits
from cadenza.llm.tokens import n_tokens
from cadenza.queries.problems import BC_NAMES, DRP_NAMES, FHSC_NAMES, S_NAMES, families
from cadenza.session import cut, table

MEASURED = FHSC_NAMES
ALL_NAMES = [*S_NAMES, *DRP_NAMES, *FHSC_NAMES, *BC_NAMES]


def _drive_keys() -> dict[str, Column]:
    return {"g": splits.normal_key(F.col("group_id")), "c": splits.numeric_key(F.col("component_id"))}


#: Percentiles that are reported.
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _load_sketches(spark: SparkSession, d: str) -> DataFrame:
    """A sketch per load, group and measurement; combinations by their families, source groups by the recording's id."""
    replay = table(spark, d, "native30_replay").select("id", "load_id", F.concat_ws("+", families(F.col("combination"))).alias("combo"), "features")
    packed = dyadic.pack_values(replay.select("id", "load_id", F.when(F.col("combo") != "", F.col("combo")).alias("combination"), "features"), ALL_NAMES, "features", ["id", "load_id", "combination"])
    sources = table(spark, d, "drive_sources").where("id is not null").groupBy("id").agg(F.min("source_group").alias("source_group"))
    # Rows without an id meet no source; a hash of the row spreads them over tasks.
    key = F.coalesce("id", F.concat(F.lit("\0"), F.xxhash64("packed").cast("string")))
    joined = packed.withColumn("key", key).join(sources.withColumnRenamed("id", "key"), "key", "left")
    return dyadic.partial_sketches(joined, ["combination", "source_group"], "load_id")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all measurements per combination and per source group, over all loads."""
    keys = ["grouping", "group_value", "c"]
    return dyadic.percentiles(dyadic.merge_sketches(_load_sketches(spark, d).drop("load_id"), keys), ALL_NAMES, PERCENTILES, keys)


def p2_by_load(spark: SparkSession, d: str) -> DataFrame:
    """Medians per load, whose sketches add up to those of p2_percentiles."""
    keys = ["grouping", "group_value", "load_id", "c"]
    return dyadic.percentiles(dyadic.merge_sketches(_load_sketches(spark, d), keys), ALL_NAMES, (0.5,), keys)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many values each group's joined sketches hold."""
    keys = ["grouping", "group_value", "c"]
    p = dyadic.percentiles(dyadic.merge_sketches(dyadic.merge_sketches(_load_sketches(spark, d)).drop("load_id"), keys), ALL_NAMES, (0.5,), keys)
    return p.select("grouping", "group_value", "feature", "n")


def p2_without_first_load(spark: SparkSession, d: str) -> DataFrame:
    """How many values each group's sketches of all loads hold once the first load's sketches have been taken away from them."""
    keys = ["grouping", "group_value", "c"]
    all_ = cut(dyadic.merge_sketches(_load_sketches(spark, d)))
    first = all_.agg(F.min("load_id")).first()[0]
    rest = all_.drop("load_id").unionByName(dyadic.deleted(all_.where(F.col("load_id") == first)).drop("load_id"))
    return dyadic.percentiles(dyadic.merge_sketches(rest, keys), ALL_NAMES, (0.5,), keys).select("grouping", "group_value", "feature", "n")


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether all percentiles of each group and measurement keep the errors stated with them, against the exact ranks of all values."""
    replay = table(spark, d, "native30_replay").select("id", F.concat_ws("+", families(F.col("combination"))).alias("combo"), F.explode("features").alias("feature", "v")).where("v is not null and not isnan(v) and abs(v) < double('Infinity')")
    sources = table(spark, d, "drive_sources").where("id is not null").groupBy("id").agg(F.min("source_group").alias("source_group"))
    x = replay.join(sources, "id", "left").select("feature", "v", F.explode(F.array(F.struct(F.lit("combination").alias("grouping"), F.when(F.col("combo") != "", F.col("combo")).alias("group_value")), F.struct(F.lit("source_group").alias("grouping"), F.col("source_group").alias("group_value")))).alias("g"))
    return dyadic.within_bounds(x.select("g.grouping", "g.group_value", "feature", "v"), cut(p2_percentiles(spark, d)), ["grouping", "group_value"])


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    drive = table(spark, d, "drive_sources")
    r = drive.select("id", "member_name", F.col("canonical.input_sha256").alias("input_sha256"), F.col("canonical.waveform_float32_sha256").alias("waveform_sha256")).where("id is not null").distinct()
    length = drive.where("id is not null").groupBy("id").agg(F.max(F.try_divide("canonical.native_frames", "canonical.native_sample_rate_hz")).alias("seconds"))
    found = overlap.measurements([(table(spark, d, "sample_reference_features"), "id", "features", "measured_at"), (table(spark, d, "native30_replay"), "id", "features", "scored_at")], MEASURED)
    s = drive.select("id", F.lower(F.trim("split")).alias("split"), "source_group").where("id is not null").distinct()
    return overlap.overlap_classes(r, table(spark, d, "generated_cleanup"), cut(length.join(found, "id")), len(MEASURED)), s


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    classes, s = _classes(spark, d)
    return overlap.cross_split_pairs(classes, s.select("id", "split")).select("id_a", "id_b")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """A row per recording that is in train and elsewhere: its class and how many records it meets on the other side."""
    classes, s = _classes(spark, d)
    return overlap.cross_split_classes(classes, s.select("id", "split"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Records of validation and test that are in train too, per split and source."""
    classes, s = _classes(spark, d)
    c = cut(classes.join(s, "id"))
    hit = c.where("split in ('validation', 'test')").join(c.where("split = 'train'").select("class_id").distinct(), "class_id", "left_semi")
    n = s.where("split in ('validation', 'test')").groupBy("split", "source_group").agg(F.countDistinct("id").alias("records"))
    return n.join(hit.groupBy("split", "source_group").agg(F.countDistinct("id").alias("also_in_train")), ["split", "source_group"], "left").fillna(0, ["also_in_train"])


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    drive = table(spark, d, "drive_sources")
    return drive, cut(splits.tied_sets(drive, "id", _drive_keys()))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    _, sets = _sets(spark, d)
    return splits.assign_splits(sets, [("train", 0.8), ("validation", 0.1), ("test", 0.1)])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    drive, sets = _sets(spark, d)
    role = F.lower(F.trim("role"))
    roles = drive.select("id", (role == "development").alias("dev"), (role == "locked").alias("lock"))
    both = sets.join(roles, "id").groupBy("set_id").agg(F.bool_or("dev").alias("dev"), F.bool_or("lock").alias("lock")).where("dev and lock")
    return sets.join(both, "set_id", "left_semi").select("id", "set_id")


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: records, sets divided between splits, and whether each share is met to a hundredth and half the largest set."""
    x = cut(p4_splits(spark, d))
    sets = x.groupBy("set_id").agg(F.count_distinct("new_split").alias("splits"), F.max("set_size").alias("size"))
    a = sets.agg(F.count_if(F.col("splits") > 1).alias("divided"), F.max("size").alias("largest"))
    part = lambda n: F.count_if(F.col("new_split") == n) / F.count(F.lit(1))
    b = x.agg(F.count_distinct("id").alias("records"), F.count(F.lit(1)).alias("rows"), F.greatest(F.abs(part("train") - 0.8), F.abs(part("validation") - 0.1), F.abs(part("test") - 0.1)).alias("gap"))
    return b.crossJoin(a).select("records", "rows", "divided", (F.col("gap") <= 0.01 + F.col("largest") / F.col("rows") / 2).alias("shares_met"))  # one row each


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", n_tokens(F.col("text")))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing divided among containers."""
    return packing.divided(_packed(spark, d)).withColumnRenamed("id", "doc_id")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing as a whole, its space used to 98 percent among it."""
    c = packing.packing_checks(cut(_packed(spark, d)))
    return c.select("items", "tokens", "placed", "overfull", "divided_though_fitting", (F.col("fill") >= 0.98).alias("filled"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), "doc_id", F.col("source"), n_tokens(F.col("text")), table(spark, d, "mixture_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that run dry in the fair queue before the virtual time at which they would have had their share."""
    return _mixed(spark, d)[1].where("cannot_reach").select("source")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sample = abuse.labelled(docs, table(spark, d, "content_labels"))
    return abuse.score(docs, abuse.fit(sample["text"].tolist(), sample["y"].to_numpy()), ["doc_id", "source"])


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "score", "flagged")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, those flagged, their rate and the mean score."""
    s = _scored(spark, d).withColumn("source", F.coalesce(mixing.normal_source(F.col("source")), F.lit("(none)")))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("int")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, those with a score from 0 to 1, and those flagged by their score and no others."""
    s = _scored(spark, d).withColumn("source", F.coalesce(mixing.normal_source(F.col("source")), F.lit("(none)")))
    return s.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("score").between(0, 1)).alias("scored"), F.count_if(F.col("flagged") == (F.col("score") >= 0.5)).alias("consistent"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("flagged").select("doc_id")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    from cadenza.llm.sql import SQL

    return dict(SQL)
