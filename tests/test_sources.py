import struct

import numpy as np
import pytest

from quernel.sources import csv, idx, params, text
from quernel.streaming.moments import windowed


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    got = csv.read(spark, write(tmp_path / "a.csv", "a,b\r\n1,2\r\n\r\n3,4\r\n"))
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [(1, 2), (3, 4)]
    assert sorted(map(tuple, csv.read(spark, write(tmp_path / "b.csv", "1,2\n3,4e1\n"), has_header=False).collect())) == [(1, 2), (3, 40)]
    assert csv.read(spark, write(tmp_path / "c.csv", "a,b\n")).count() == 0
    for name, bad in (("ragged", "a,b\n1,2\n3\n"), ("long", "a,b\n1,2\n3,4,5\n"), ("empty", "a,b,c\n1,,2\n"), ("word", "a\nx\n")):
        with pytest.raises(Exception):  # noqa: B017
            csv.read(spark, write(tmp_path / f"{name}.csv", bad)).collect()
    with pytest.raises(Exception):  # noqa: B017
        csv.read(spark, str(tmp_path / "none.csv")).collect()


def test_idx(spark, tmp_path):
    pixels = np.arange(3 * 4, dtype=np.uint8)
    x = write(tmp_path / "x", struct.pack(">IIII", 0x803, 3, 2, 2) + pixels.tobytes())
    y = write(tmp_path / "y", struct.pack(">II", 0x801, 3) + bytes([7, 0, 9]))
    rows = idx.read(spark, x, y).orderBy("id").collect()
    assert [r.label for r in rows] == [7, 0, 9] and rows[1].image == pytest.approx([4 / 255, 5 / 255, 6 / 255, 7 / 255])
    assert idx.read(spark, x, y, max_items=2).count() == 2
    for bad in (struct.pack(">II", 0x803, 3) + bytes(3), struct.pack(">II", 0x801, 2) + bytes(2), struct.pack(">II", 0x801, 3)):
        with pytest.raises(Exception):  # noqa: B017
            idx.read(spark, x, write(tmp_path / "bad", bad)).collect()


def test_text(spark, tmp_path):
    path = write(tmp_path / "t.txt", "1.. first\nsecond\n")
    assert text.read(spark, path).first().text == "1.. first\nsecond\n"
    assert [r.line for r in text.cleaned(spark, path, path).collect()] == ["first", "second", "1.. first", "second"]
    assert text.read_or(spark, str(tmp_path / "none"), ["a", "b"]).first().text == "a\nb\n"
    assert spark.createDataFrame([(" 1 2.5  x ",), ("",)], "s string").select(text.numbers("s")).collect()[0][0] == [1, 2.5, None]


def test_params(spark, tmp_path):
    own = {"a": np.array([[1.0, 2], [3, 4]]), "b": np.array([[5.0]])}
    params.save(params.frame(spark, own), str(tmp_path / "p"))
    back = params.arrays(params.load(spark, str(tmp_path / "p")))
    assert all((back[k] == v).all() for k, v in own.items())
    assert {r.name: (r.rows, r.cols) for r in params.shapes(params.frame(spark, own)).collect()} == {"a": (2, 2), "b": (1, 1)}


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 50, 10)], "t string, value double").selectExpr("to_timestamp(t) AS ts", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = windowed(stream, "value", window="30 minutes").writeStream.format("memory").queryName("moments").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = windowed(events, "value", window="30 minutes")
    assert sorted(map(str, spark.table("moments").collect())) == sorted(map(str, batch.collect()))
