"""Queries of sources and sinks (SRC, SNK): round trips through the shared folder and scans of the tables."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.metrics import six
from cadenza.queries._cohort import C, cohort
from cadenza.registry import Registry
from cadenza.session import shared_folder, table
from cadenza.sources import files

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@R("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where s_acctbal > 0")
def src_01_csv(spark: SparkSession, d: str) -> DataFrame:
    files.write_delimited(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), p := _path(spark))
    return files.read_delimited(spark, p, SUPPLIER).where("s_acctbal > 0")


@R("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def src_02_tsv(spark: SparkSession, d: str) -> DataFrame:
    files.write_delimited(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), p := _path(spark), "\t")
    return files.read_delimited(spark, p, SUPPLIER, "\t")


@R("select event_id, user_id, props from events")
def src_04_json_lines(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").select("event_id", "user_id", "props").write.json(p := _path(spark))
    return files.read_lines(spark, p, "event_id bigint, user_id bigint, props string")


@R("with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) o from events) select user_id, event_id, event_type from r where o = 1")
def src_05_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return files.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@R("select l_orderkey, l_shipdate from lineitem where l_shipdate >= timestamp '1998-06-01'")
def src_06_parquet_pruned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp")).select("l_orderkey", "l_shipdate")


@R("select vec_id, label from embeddings where vec_id in (select event_id from events)")
def src_07_rows_by_id(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.col("event_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", "label").join(ids, "vec_id", "left_semi")


@R("select o_orderstatus, count(*) as n from orders group by 1")
def src_08_sql_over_parquet(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("select o_orderstatus, count(*) as n from {orders} group by 1", orders=table(spark, d, "orders"))


@R("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def src_09_gzip_csv(spark: SparkSession, d: str) -> DataFrame:
    files.write_delimited(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), p := _path(spark), compression="gzip")
    return files.read_delimited(spark, p, SUPPLIER)


@R("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def src_21_nested_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


ODD = "case k % 4 when 0 then '{\"k\": ' || k || '}' when 1 then '{\"k\": 1, \"k\": ' || k || '}' when 2 then '{\"k\": NaN}' else '{\"k\": ' end"


@R(f"with {C} select id, case k % 4 when 0 then 'ok' when 1 then 'repeated key' when 2 then 'constant' else 'broken' end as status from c")
def src_03_strict_json(spark: SparkSession, d: str) -> DataFrame:
    """Texts with repeated keys, constants that are no JSON, or no end are told apart and not read."""
    return cohort(spark, d).select("id", files.strict_status(F.expr(ODD)).alias("status"))


def _packed(spark: SparkSession, d: str, pack) -> DataFrame:
    """(path, content): a file for each recording, packed from its vectors (vec_id, x) by ``pack``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "content": [pack(pdf["vec_id"].tolist(), [np.asarray(v, "<f4") for v in pdf["embedding"]])]})

    path = F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("vec_id") / 500).cast("string"))
    return table(spark, d, "embeddings").select(path.alias("path"), "vec_id", "embedding").groupBy("path").applyInPandas(run, "path string, content binary")


PATHS = "e as (select label::varchar || '-' || (vec_id // 500)::varchar as path, vec_id, embedding, row_number() over (partition by label, vec_id // 500 order by vec_id) - 1 as place from embeddings)"
SAMPLES = f"{PATHS}, x as (select path, place * 64 + i as frame, greatest(-32768, least(32767, round_even(v * 32768, 0))) as q from (select path, place, unnest(range(64)) as i, unnest(embedding)::double as v from e))"


@R(f"with {SAMPLES} select path, 'ok' as status, 8000 as rate, count(*) as frames, sum(q)::bigint as total from x group by 1")
def src_10_decode_wav(spark: SparkSession, d: str) -> DataFrame:
    """Each recording as a PCM file, decoded to its end."""
    w = files.read_wav(_packed(spark, d, lambda ids, x: files.encode_wav(8000, np.concatenate(x))))
    return w.select("path", "status", "rate", "frames", F.aggregate("left", F.lit(0.0), lambda a, v: a + v * 32768).cast("bigint").alias("total"))


@R(f"with {SAMPLES}, y as (select path, q / 32768.0::double as v from x where frame between 16 and 63), m as (select path, avg(v) as m from y group by 1) select y.path, 8000 as rate, count(*) as frames, round(sqrt(avg((v - m) * (v - m))), 6) as rms from y join m using (path) group by 1")
def src_11_exact_crop(spark: SparkSession, d: str) -> DataFrame:
    """48 frames from the 16th of each file, mono, without their mean."""
    c = files.read_crops(_packed(spark, d, lambda ids, x: files.encode_wav(8000, np.concatenate(x))), 16, 48)
    return c.select("path", "rate", F.size("samples").cast("bigint").alias("frames"), six(F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / F.size("samples")), "rms"))


@R(f"with {C} select value as t, 1 + id % 4 as n from c where value <= 30 + 1e-6")
def src_12_beats(spark: SparkSession, d: str) -> DataFrame:
    cohort(spark, d).select("value", 1 + F.col("id") % 4).write.option("sep", "\t").csv(p := _path(spark))
    return files.read_beats(spark, p, 30.0).select("t", F.col("n").cast("bigint").alias("n"))


@R("select vec_id::varchar as name, 64::int as width, round(list_sum(list_transform(embedding, lambda v: v::double)), 6) as total from embeddings")
def src_13_npz(spark: SparkSession, d: str) -> DataFrame:
    def pack(ids: list, x: list) -> bytes:
        np.savez(out := io.BytesIO(), **{str(i): v for i, v in zip(ids, x)})
        return out.getvalue()

    return files.read_npz(_packed(spark, d, pack)).select("name", F.element_at("shape", 1).alias("width"), six(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), "total"))


def _tar(mode: str, name):
    def pack(ids: list, x: list) -> bytes:
        with tarfile.open(fileobj=(out := io.BytesIO()), mode=mode, format=tarfile.PAX_FORMAT) as t:
            for i, v in zip(ids, x):
                (m := tarfile.TarInfo(name(i))).size = v.nbytes
                t.addfile(m, io.BytesIO(v.tobytes()))
        return out.getvalue()

    return pack


@R(f"with {PATHS} select path, 'v/' || vec_id::varchar || '.f4' as name, 512 + place * 1024 as offset, 256::bigint as size from e")
def src_14_tar_index(spark: SparkSession, d: str) -> DataFrame:
    """Members of archives with the place of their bytes."""
    return files.tar_members(_packed(spark, d, _tar("w", lambda i: f"v/{i}.f4")))


@R(f"with {PATHS} select path, case when vec_id % 5 = 0 then '../' || vec_id::varchar else 'v/' || vec_id::varchar end as name, 256::bigint as size, case when vec_id % 5 = 0 then 'unsafe_name' else 'ok' end as status, vec_id % 5 <> 0 as has_content from e")
def src_18_zip_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Members of archives; those whose names lead out of the archive are listed and not read."""
    def pack(ids: list, x: list) -> bytes:
        with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
            for i, v in zip(ids, x):
                z.writestr(f"../{i}" if i % 5 == 0 else f"v/{i}", v.tobytes())
        return out.getvalue()

    return files.zip_members(_packed(spark, d, pack)).select("path", "name", "size", "status", F.col("content").isNotNull().alias("has_content"))


@R("select vec_id, label, sha256(round(embedding[1]::double, 6)::varchar) is not null as read, 256::bigint as bytes from embeddings")
def src_19_catalogued_members(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of names joined to the members of packed archives."""
    m = files.tar_contents(_packed(spark, d, _tar("w:gz", lambda i: f"annotations/{i}.f4"))).select("name", F.length("content").cast("bigint").alias("bytes"))
    c = table(spark, d, "embeddings").select("vec_id", "label", F.concat(F.lit("annotations/"), F.col("vec_id").cast("string"), F.lit(".f4")).alias("name"))
    return c.join(m, "name", "left").select("vec_id", "label", F.col("bytes").isNotNull().alias("read"), "bytes")


def _midi(rows: list[tuple[int, int, int]]) -> bytes:
    """A file of one track: notes (tick, pitch, velocity) of 240 ticks at 480 a quarter, twice as fast from tick 4,800 on."""

    def number(v: int) -> bytes:
        out = bytes([v & 127])
        while v := v >> 7:
            out = bytes([128 | v & 127]) + out
        return out

    events = sorted([(0, 0, b"\xff\x51\x03" + (500_000).to_bytes(3, "big")), (4800, 0, b"\xff\x51\x03" + (250_000).to_bytes(3, "big")), *[(t, 2, bytes([0x90, p, v])) for t, p, v in rows], *[(t + 240, 1, bytes([0x80, p, 0])) for t, p, _ in rows]])
    body, last = b"", 0
    for t, _, e in events:
        body += number(t - last) + e
        last = t
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) + b"MTrk" + struct.pack(">I", len(body)) + body


@R(f"with {C}, n as (select user_id, k, id, row_number() over (partition by user_id order by ts, id) - 1 as i from c) select user_id::varchar as path, round(case when i <= 10 then i * 0.5 else 5 + (i - 10) * 0.25 end, 6) as onset, 30 + k % 60 as pitch, (1 + id % 100)::int as velocity, case when i < 10 then 0.25 else 0.125 end as duration from n")
def src_20_midi_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of a file per user, timed through a change of tempo."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"])
        return pd.DataFrame({"path": pdf["user_id"].iloc[:1].astype(str), "content": [_midi([(480 * i, 30 + int(k) % 60, 1 + int(e) % 100) for i, (k, e) in enumerate(zip(pdf["k"], pdf["id"]))])]})

    m = files.read_midi(cohort(spark, d).select("user_id", "ts", "id", "k").groupBy("user_id").applyInPandas(run, "path string, content binary"))
    return m.select("path", six("onset", "onset"), "pitch", "velocity", six("duration", "duration"))


@R("select doc_id, sha256(text) as digest from documents where text is not null")
def snk_01_csv_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with quotes, separators and line breaks through delimited files."""
    files.write_delimited(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), p := _path(spark))
    back = files.read_delimited(spark, p, "doc_id bigint, text string", lines=True)
    return back.select("doc_id", F.sha2("text", 256).alias("digest"))


@R("select unnest(['first', 'second']) as attempt, unnest(['written', 'refused']) as outcome")
def snk_02_exclusive_json(spark: SparkSession, d: str) -> DataFrame:
    """A table of JSON lines is written once and never over another."""
    from pyspark.errors import AnalysisException

    p, out = _path(spark), []
    for attempt in ("first", "second"):
        try:
            table(spark, d, "nation").write.mode("errorifexists").json(p)
            out.append((attempt, "written"))
        except AnalysisException:
            out.append((attempt, "refused"))
    return spark.createDataFrame(out, "attempt string, outcome string")


@R("select unnest(['first', 'second']) as attempt, unnest([true, false]) as published, 'one' as content")
def snk_03_atomic_publish(spark: SparkSession, d: str) -> DataFrame:
    """A small file is published whole, and a second one doesn't replace it."""
    p = _path(spark)
    rows = [(a, files.publish(spark, p, t.encode())) for a, t in (("first", "one"), ("second", "two"))]
    text = spark.read.format("binaryFile").load(p).select(F.col("content").cast("string").alias("content"))
    return spark.createDataFrame(rows, "attempt string, published boolean").crossJoin(F.broadcast(text))  # one row


@R(f"with {C} select source_group, count(*) as rows, true as same, true as readable from c group by 1")
def snk_04_reproducible_gzip(spark: SparkSession, d: str) -> DataFrame:
    """Predictions in parts of 1,000 rows, packed twice: equal bytes, and the lines are in them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = "".join(f"{i},{s:.6f}\n" for i, s in sorted(zip(pdf["id"], pdf["score"]))).encode()
        a, b = files.gzip_bytes(lines), files.gzip_bytes(bytes(lines))
        return pd.DataFrame({"source_group": pdf["source_group"].iloc[:1], "n": [len(pdf)], "same": [a == b], "readable": [gzip.decompress(a) == lines]})

    c = cohort(spark, d).select("source_group", "id", "score", F.floor(F.col("id") / 1000).alias("part"))
    x = c.groupBy("source_group", "part").applyInPandas(run, "source_group string, n bigint, same boolean, readable boolean")
    return x.groupBy("source_group").agg(F.sum("n").alias("rows"), F.bool_and("same").alias("same"), F.bool_and("readable").alias("readable"))


@R(f"""with {C} select id, sha256('{{"id":' || id || ',"k":' || k || ',"source":"' || source_group || '"}}' || chr(10)) as digest from c""")
def snk_05_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Sorted keys, compact separators, a line feed."""
    return cohort(spark, d).select("id", files.canonical_digest(F.struct(F.col("source_group").alias("source"), "k", "id")).alias("digest"))


@R("select unnest(['changed', 'extra', 'missing', 'ok']) as status, unnest([1, 1, 1, 3])::bigint as files")
def snk_06_product_inventory(spark: SparkSession, d: str) -> DataFrame:
    """A written table's files against an inventory with one digest changed, one file left out and one that doesn't exist."""
    from pyspark.sql import Window as W

    table(spark, d, "nation").repartitionByRange(5, "n_nationkey").write.parquet(p := _path(spark))
    have = files.inventory(files.binary_files(spark, p, "*.parquet"))
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("path"))  # five files
    want = have.withColumn("place", place).where("place <> 1").select("path", F.when(F.col("place") == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    want = want.unionAll(spark.createDataFrame([("nowhere", "0" * 64)], "path string, sha256 string"))
    return files.verify_inventory(want, have).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "number int, line string")


@R("""with r as (select n_name, case when n_nationkey % 2 = 0 then printf('%.6f', n_nationkey / 7.0::double) else 'unavailable' end as cell, (row_number() over (order by n_name) + 1)::int as n from nation)
  select 0 as number, '| n_name | value |' as line union all select 1, '| --- | --- |' union all select n, '| ' || n_name || ' | ' || cell || ' |' from r""")
def snk_07_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A report of the nations as Markdown, by line."""
    x = table(spark, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 7.0).alias("value")).orderBy("n_name")
    return _lines(spark, files.markdown(x, ["n_name", "value"]))


@R("""with p as (select r_name, sum(n_nationkey) filter (n_nationkey % 2 = 0) as even, sum(n_nationkey) filter (n_nationkey % 2 = 1) as odd from nation join region on n_regionkey = r_regionkey group by 1), q as (select *, (row_number() over (order by r_name) - 1)::int as number from p)
  select number, r_name || ' & ' || coalesce(printf('%.2f', even::double), '--') || ' & ' || coalesce(printf('%.2f', odd::double), '--') || ' ' || chr(92) || chr(92) as line from q""")
def snk_08_latex(spark: SparkSession, d: str) -> DataFrame:
    """Sums of even and odd keys per region as LaTeX, by line."""
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("side", F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"))
    return _lines(spark, files.latex(x.groupBy("r_name", "side").agg(F.sum("n_nationkey").cast("double").alias("v")), "r_name", "side", "v"))


@R("select label, count(*) as frames, round(sum(list_sum(list_transform(embedding, lambda v: v::double))), 4) as total from embeddings group by 1")
def snk_09_frame_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Frames as arrays in a folder per recording, read again."""
    table(spark, d, "embeddings").select("label", "vec_id", "embedding").write.partitionBy("label").parquet(p := _path(spark))
    x = spark.read.parquet(p).groupBy("label").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))), 4).alias("total"))
    return x.select("label", "frames", "total")
