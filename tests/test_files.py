import io
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest

from cadenza.sources import files


def test_delimited_round_trip_and_no_overwriting(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'q"x')], "id int, t string")
    files.write_delimited(df, p := str(tmp_path / "c"), compression="gzip")
    assert sorted(map(tuple, files.read_delimited(spark, p, "id int, t string").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="exists"):
        files.write_delimited(df, p)


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "k int, at int, v string")
    assert sorted((r["k"], r["v"]) for r in files.latest(df, ["k"], ["at"]).collect()) == [(1, "c"), (2, None)]


def test_json_rules(tmp_path):
    assert files.strict_json('{"a": [1, 2]}') == {"a": [1, 2]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[Infinity]"):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    assert files.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}\n'.encode()
    assert files.canonical_hash({}) != files.canonical_hash({}, False)
    files.write_new(p := str(tmp_path / "x"), b"1")
    with pytest.raises(FileExistsError):
        files.write_new(p, b"2")
    assert open(p, "rb").read() == b"1" and files.gzip_bytes(b"abc") == files.gzip_bytes(b"abc")


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for n, b in (("x" * 150 + "/y.bin", b"12345"), ("z", b"")):
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("ok/a.txt", "hi")
        z.writestr("../evil", "no")
    got = files.tar_members(files.binary_files(spark, str(tmp_path), "*.tar")).collect()
    raw = (tmp_path / "a.tar").read_bytes()
    assert sorted(raw[r["offset"] : r["offset"] + r["size"]] for r in got) == [b"", b"12345"]
    z = {r["name"]: (r["status"], r["content"]) for r in files.zip_members(files.binary_files(spark, str(tmp_path), "*.zip")).collect()}
    assert z["ok/a.txt"] == ("ok", bytearray(b"hi")) and z["../evil"] == ("unsafe_name", None)
    assert {r["status"] for r in files.zip_members(files.binary_files(spark, str(tmp_path), "*.zip"), 1).collect()} == {"too_large", "unsafe_name"}
    have = files.inventory(files.binary_files(spark, str(tmp_path)))
    assert {r["status"] for r in files.verify_inventory(have, have).collect()} == {"ok"}


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav(spark, tmp_path, width):
    x = np.sin(np.arange(200) / 7)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(8000)
        top = (1 << (8 * width - 1)) - 1
        v = np.round(x * top).astype(np.int64) + (128 if width == 1 else 0)
        w.writeframes(b"".join(int(s).to_bytes(width, "little", signed=width > 1) for s in v))
    r = files.read_wav(files.binary_files(spark, str(tmp_path), "*.wav")).first()
    assert (r["rate"], r["channels"], r["frames"], r["right"]) == (8000, 1, 200, None)
    assert np.abs(np.array(r["left"]) - x).max() < 2.1 / (1 << (8 * width - 1))


def test_files_that_are_no_wav_have_a_status_and_crops_are_exact(spark):
    x = np.stack([np.linspace(-0.5, 0.5, 100), np.full(100, 0.25)], 1)
    good = files.encode_wav(8000, x)
    f = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"fLaC....")), ("c", bytearray(b"RIFF....")), ("d", bytearray(b""))], "path string, content binary")
    assert {r["path"]: r["status"] for r in files.read_wav(f).collect()} == {"a": "ok", "b": "unsupported", "c": "broken", "d": "unsupported"}
    rate, v = files.crop_wav(good, 10, 30)
    want = x[10:40].mean(1)
    assert rate == 8000 and np.abs(v - (want - want.mean())).max() < 1e-4
    for start, n in ((90, 11), (-1, 5)):
        with pytest.raises(ValueError):
            files.crop_wav(good, start, n)


def test_strict_status_and_publishing(spark, tmp_path):
    t = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1, "a": 1}'), (3, "[-Infinity]"), (4, "{"), (5, None), (6, ""), (7, "[" * 5000)], "n int, t string")
    assert [r[0] for r in t.orderBy("n").select(files.strict_status(t["t"])).collect()] == ["ok", "repeated key", "constant", "broken", None, "broken", "broken"]
    assert files.publish(spark, p := str(tmp_path / "x"), b"1") and not files.publish(spark, p, b"2")
    assert open(p, "rb").read() == b"1" and [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["x"]


def test_npz_and_midi(spark, tmp_path):
    np.savez(tmp_path / "a.npz", g=np.arange(6).reshape(2, 3))
    r = files.read_npz(files.binary_files(spark, str(tmp_path), "*.npz")).first()
    assert (r["name"], r["shape"], r["values"]) == ("g", [2, 3], [0, 1, 2, 3, 4, 5])
    ev = b"\x00\xff\x51\x03" + (500_000).to_bytes(3, "big") + b"\x00\x90\x3c\x40" + b"\x60\x80\x3c\x00" + b"\x00\xff\x51\x03" + (250_000).to_bytes(3, "big") + b"\x60\x90\x3e\x50" + b"\x60\x3e\x00" + b"\x00\xff\x2f\x00"
    mid = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(ev)) + ev
    assert files.midi_notes(mid) == [(0.0, 60, 64, 0.5), (0.75, 62, 80, 0.25)]


def test_reports(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", 2.5)], "r string, c string, v double")
    assert "| a | unavailable |" in files.markdown(df, ["r", "v"])
    with pytest.raises(ValueError):
        files.markdown(df, ["r"], most=2)
    assert files.latex(df, "r", "c", "v").splitlines() == [r"a & 1.00 & -- \\", r"b & 2.50 & -- \\"]
