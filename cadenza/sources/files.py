"""File sources and sinks: delimited text, JSON, archives, audio and arrays, with explicit schemas."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
import os
import struct
import tarfile
import wave
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts come back as they were: blanks at the ends are kept, quotes are doubled, an empty text is no null.
EXACT = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "emptyValue": "", "nullValue": "\\N"}


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", lines: bool = False) -> DataFrame:
    """CSV (or TSV) with a header and a given schema; gzip by suffix; ``lines`` if fields hold line breaks (a file is then one task's). A row that doesn't fit the schema fails."""
    return spark.read.schema(schema).options(**EXACT, sep=sep, multiLine=lines, mode="FAILFAST").csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", compression: str | None = None) -> None:
    """Never overwrites. Fields are quoted where they have to be."""
    df.write.mode("errorifexists").options(**EXACT, sep=sep, compression=compression or "none").csv(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a given schema; a broken line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in an append log; pre-aggregated, so a key with a third of the rows is not gathered."""
    rest = [c for c in df.columns if c not in keys]
    first = [*order, *[c for c in rest if c not in order]]
    return df.groupBy(*keys).agg(F.max(F.struct(*first)).alias("__l")).select(*keys, *[F.col("__l")[c].alias(c) for c in rest])


def strict_json(text: str):
    """The JSON value of a text; repeated keys, NaN and infinite constants are errors."""

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        return out

    def constant(name: str):
        raise ValueError(f"constant {name}")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def strict_status(c: Column) -> Column:
    """What a strict reading of a JSON text gives: ok, repeated key, constant (NaN, Infinity), broken, or null for null."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                strict_json(t)
            except json.JSONDecodeError:
                return "broken"
            except RecursionError:
                return "broken"
            except ValueError as e:
                return "repeated key" if "repeated" in str(e) else "constant"
            return "ok"

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def canonical_digest(value: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct; null for null."""

    def run(rows: pd.DataFrame) -> pd.Series:
        plain = lambda v: v.item() if hasattr(v, "item") else v
        return pd.Series([canonical_hash({k: plain(v) for k, v in r.items()}) for r in rows.to_dict("records")], dtype=object)

    return F.pandas_udf(run, "string")(value)


def publish(spark: SparkSession, path: str, data: bytes) -> bool:
    """Puts a small file in place whole, on any file system of the session, and never over another: written aside, then renamed. False if the name is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{os.getpid()}.tmp"))
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        return False
    out = fs.create(aside, True)
    out.write(bytearray(data))
    out.close()
    if fs.exists(to) or not fs.rename(aside, to):
        fs.delete(aside, False)
        return False
    return True


def canonical_json(value, line_feed: bool = True) -> bytes:
    """Sorted keys, compact separators, UTF-8, finite numbers; with a line feed at the end or without (their hashes differ)."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode() + b"\n" * line_feed


def canonical_hash(value, line_feed: bool = True) -> str:
    return hashlib.sha256(canonical_json(value, line_feed)).hexdigest()


def write_new(path: str, data: bytes) -> None:
    """Publishes a small file whole and never over another: a temporary file, synced, then linked to its name."""
    tmp = f"{path}.{os.getpid()}.tmp"
    try:
        with open(tmp, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.link(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)


def gzip_bytes(data: bytes) -> bytes:
    """Reproducible gzip: no time, no name."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as f:
        f.write(data)
    return out.getvalue()


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def inventory(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of binary files."""
    return files.select("path", F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_inventory(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): missing, extra, changed or ok."""
    e, f = expected.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("have"))
    s = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") != F.col("want"), "changed").otherwise("ok")
    return e.join(f, "path", "full").select("path", s.alias("status"))


def _expand(files: DataFrame, schema: str, rows) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in rows(bytes(c))]
            if out:
                yield pd.DataFrame(out)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def safe_member(name: str) -> bool:
    return bool(name) and not name.startswith("/") and "\\" not in name and "\0" not in name and not any(p in ("", ".", "..") for p in name.rstrip("/").split("/"))


def tar_members(files: DataFrame) -> DataFrame:
    """(path, name, offset, size) of regular members, long names included; offsets are into the (uncompressed) archive."""
    return _expand(files, "name string, offset bigint, size bigint", lambda b: [(m.name, m.offset_data, m.size) for m in tarfile.open(fileobj=io.BytesIO(b)) if m.isreg()])


def tar_contents(files: DataFrame) -> DataFrame:
    """(path, name, content) of regular members of tar archives, packed or not."""
    return _expand(files, "name string, content binary", lambda b: [(m.name, t.extractfile(m).read()) for t in [tarfile.open(fileobj=io.BytesIO(b))] for m in t if m.isreg()])


def zip_members(files: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """(path, name, size, status, content): every member; status ok, unsafe_name or too_large (above ``most_bytes``), content only where it is ok."""

    def rows(b: bytes) -> list:
        with zipfile.ZipFile(io.BytesIO(b)) as z:
            out = []
            for i in z.infolist():
                if not i.is_dir():
                    status = "unsafe_name" if not safe_member(i.filename) else "too_large" if i.file_size > most_bytes else "ok"
                    out.append((i.filename, i.file_size, status, z.read(i) if status == "ok" else None))
            return out

    return _expand(files, "name string, size bigint, status string, content binary", rows)


def encode_wav(rate: int, x: np.ndarray) -> bytes:
    """PCM WAV of 16 bits from samples (x channels) in [-1, 1); values outside are clipped."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def crop_wav(data: bytes, start: int, frames: int) -> tuple[int, np.ndarray]:
    """(rate, mono samples without their mean) of exactly ``frames`` frames from ``start``; only they are read. Fails where the file ends before."""
    with wave.open(io.BytesIO(data)) as w:
        if start < 0 or start + frames > w.getnframes():
            raise ValueError("the crop lies outside the file")
        w.setpos(start)
        raw, own = w.readframes(frames), io.BytesIO()
        with wave.open(own, "wb") as o:
            o.setparams(w.getparams())
            o.writeframes(raw)
    rate, x = decode_wav(own.getvalue())
    mono = x.mean(axis=1)
    return rate, mono - mono.mean()


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples x channels as floats in [-1, 1)) of PCM WAV with 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        rate, ch, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (v - ((v & 0x800000) << 1)) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, ch)


def read_wav(files: DataFrame) -> DataFrame:
    """(path, status, rate, channels, frames, left array<double>, right array<double>): a row per file; right is null for mono.

    status is ok, unsupported (no PCM WAV: other codecs need a decoder that isn't here) or broken.
    """
    def rows(b: bytes) -> list:
        if b[:4] != b"RIFF":
            return [("unsupported", None, None, None, None, None)]
        try:
            rate, x = decode_wav(b)
        except (wave.Error, EOFError, ValueError):
            return [("broken", None, None, None, None, None)]
        return [("ok", rate, x.shape[1], len(x), x[:, 0].tolist(), x[:, 1].tolist() if x.shape[1] > 1 else None)]

    return _expand(files, "status string, rate int, channels int, frames bigint, left array<double>, right array<double>", rows)


def read_crops(files: DataFrame, start: int, frames: int) -> DataFrame:
    """(path, rate, samples array<double>): the same stretch of each WAV file, see crop_wav."""
    return _expand(files, "rate int, samples array<double>", lambda b: [(r, x.tolist()) for r, x in [crop_wav(b, start, frames)]])


def read_npz(files: DataFrame) -> DataFrame:
    """(path, name, shape array<int>, values array<double>) of each numeric array."""
    def rows(b: bytes) -> list:
        with np.load(io.BytesIO(b), allow_pickle=False) as z:
            return [(n, list(z[n].shape), z[n].astype(float).ravel().tolist()) for n in z.files]

    return _expand(files, "name string, shape array<int>, values array<double>", rows)


def midi_notes(data: bytes) -> list[tuple[float, int, int, float]]:
    """(onset s, pitch, velocity, duration s) of a standard MIDI file, through its tempo changes."""
    if data[:4] != b"MThd":
        raise ValueError("no MIDI header")
    tracks, division = struct.unpack(">HH", data[10:14])
    if division & 0x8000:
        raise ValueError("frames per second are not supported")
    at, events = 8 + struct.unpack(">I", data[4:8])[0], []
    for _ in range(tracks):
        end = at + 8 + struct.unpack(">I", data[at + 4 : at + 8])[0]
        at += 8
        tick, status = 0, 0

        def number() -> int:
            nonlocal at
            v = 0
            while True:
                b = data[at]
                at += 1
                v = v << 7 | b & 127
                if b < 128:
                    return v

        while at < end:
            tick += number()
            if data[at] & 0x80:
                status = data[at]
                at += 1
            if status == 0xFF:
                kind = data[at]
                at += 1
                n = number()
                if kind == 0x51:
                    events.append((tick, 0, "tempo", int.from_bytes(data[at : at + 3], "big"), 0))
                at += n
            elif status in (0xF0, 0xF7):
                n = number()
                at += n
            else:
                kind, n = status & 0xF0, 1 if status & 0xF0 in (0xC0, 0xD0) else 2
                a, b = data[at], data[at + 1] if n == 2 else 0
                at += n
                if kind == 0x90 and b:
                    events.append((tick, 2, "on", a, b))
                elif kind in (0x80, 0x90):
                    events.append((tick, 1, "off", a, 0))
        at = end
    now, last, tempo, open_, out = 0.0, 0, 500_000, {}, []
    for tick, _, kind, a, b in sorted(events):
        now += (tick - last) * tempo / division / 1e6
        last = tick
        if kind == "tempo":
            tempo = a
        elif kind == "on":
            open_.setdefault(a, []).append((now, b))
        elif open_.get(a):
            t, v = open_[a].pop(0)
            out.append((t, a, v, now - t))
    return sorted(out)


def read_midi(files: DataFrame) -> DataFrame:
    return _expand(files, "onset double, pitch int, velocity int, duration double", midi_notes)


def read_beats(spark: SparkSession, path: str, duration: float) -> DataFrame:
    """Beats (t, n) up to the duration; an empty file is legal."""
    return spark.read.schema("t double, n int").option("sep", "\t").csv(path).where(F.col("t") <= duration + 1e-6)


def report(df: DataFrame, most: int = 1000) -> list:
    """The rows of a small report; one of more than ``most`` rows fails instead of being cut."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def markdown(df: DataFrame, columns: Sequence[str], most: int = 1000) -> str:
    """A small report as a Markdown table: six decimals, missing as 'unavailable'."""
    cell = lambda v: "unavailable" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in report(df.select(*columns), most))]) + "\n"


def latex(df: DataFrame, row: str, column: str, value: str, most: int = 1000) -> str:
    """A small report as LaTeX lines, pivoted; two decimals, missing as a dash."""
    p = df.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row)
    names = [c for c in p.columns if c != row]
    return "\n".join(" & ".join([str(r[row]), *("--" if r[c] is None else f"{r[c]:.2f}" for c in names)]) + r" \\" for r in report(p, most)) + "\n"
