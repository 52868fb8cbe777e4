import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.sources import binary, idx


def rows(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "row_id long, v array<double>").repartition(3)


def back(df):
    return np.array([r.v for r in df.orderBy("matrix", "row_id").collect()])


@pytest.mark.parametrize("layout, shape", [("floats", (6,)), ("idx", (2, 3))])
def test_round_trip_in_several_tasks(spark, tmp_path, layout, shape):
    m = np.random.default_rng(1).integers(0, 256, (101, 6)).astype(float)
    path = f"file://{tmp_path}/m"
    binary.save(rows(spark, m), path, shape, layout)
    df = binary.load(spark, path, layout, split=100)
    assert np.array_equal(back(df), m) and df.rdd.getNumPartitions() > 4
    assert [r.row_id for r in df.orderBy("row_id").select("row_id").collect()] == list(range(101))
    # the pieces in order are a plain file of the layout
    whole = b"".join(open(p, "rb").read() for p, _ in binary.Found(path).pieces)
    (tmp_path / "one").write_bytes(whole)
    assert np.array_equal(back(binary.load(spark, f"{tmp_path}/one", layout, split=60)), m)
    assert binary.load(spark, path, layout, max_items=7, split=10).count() == 7
    with pytest.raises(Exception, match="exists"):
        binary.save(rows(spark, m), path, shape, layout)
    binary.save(rows(spark, m[:5]), path, shape, layout, overwrite=True)
    assert np.array_equal(back(binary.load(spark, path, layout)), m[:5])


def test_several_matrices_in_a_file(spark, tmp_path):
    own = [np.array([[1.0, 2], [3, 4], [5, 6]]), np.zeros((0, 3)), np.array([[7.5, -1, 2, 0.25]])]
    path = str(tmp_path / "model")
    binary.save_arrays(path, own)
    assert all(np.array_equal(a, b) for a, b in zip(binary.load_arrays(path), own))
    assert open(path, "rb").read()[:20] == b"MLCP" + struct.pack("<IIII", 1, 3, 3, 2)
    got = binary.load(spark, path, split=8).orderBy("matrix", "row_id").collect()
    assert [(r.matrix, r.row_id, r.v) for r in got] == [(0, 0, [1, 2]), (0, 1, [3, 4]), (0, 2, [5, 6]), (2, 0, [7.5, -1, 2, 0.25])]


def test_truncated_and_foreign_files(spark, tmp_path):
    binary.save_arrays(str(tmp_path / "m"), [np.ones((4, 4))])
    whole = (tmp_path / "m").read_bytes()
    for n in (0, 3, 10, 19, len(whole) - 1):
        (tmp_path / "cut").write_bytes(whole[:n])
        with pytest.raises(Exception, match="short|begin"):
            binary.load(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "cut").write_bytes(struct.pack(">IIII", 0x803, 2, 2, 2) + bytes(7))
    with pytest.raises(Exception, match="short"):
        binary.load(spark, str(tmp_path / "cut"), "idx").collect()
    binary.save(rows(spark, np.ones((50, 4))), str(tmp_path / "d"), (4,))
    piece = next(p for p in (tmp_path / "d").iterdir() if p.name.startswith("piece"))
    piece.write_bytes(piece.read_bytes()[:-1])
    with pytest.raises(Exception, match="short"):
        binary.load(spark, str(tmp_path / "d")).collect()
    (tmp_path / "d" / binary.MANIFEST).unlink()
    with pytest.raises(Exception, match="manifest"):
        binary.load(spark, str(tmp_path / "d")).collect()
    with pytest.raises(FileNotFoundError):
        binary.Found(str(tmp_path / "none"))


def test_a_failed_write_leaves_no_result(spark, tmp_path):
    bad = rows(spark, np.ones((60, 4))).withColumn("v", F.when(F.col("row_id") == 59, F.array(F.lit(1.0))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="another length"):
        binary.save(bad, str(tmp_path / "d"), (4,))
    assert not (tmp_path / "d").exists() or not any(p.name in (binary.MANIFEST, binary.HEADER) for p in (tmp_path / "d").iterdir())
    with pytest.raises(Exception, match="no byte"):
        binary.save(rows(spark, np.full((3, 4), 256.0)), str(tmp_path / "e"), (2, 2), "idx")


def test_empty(spark, tmp_path):
    for layout, shape in (("floats", (4,)), ("idx", (2, 2))):
        binary.save(rows(spark, np.ones((1, 4))).limit(0), f"{tmp_path}/{layout}", shape, layout)
        assert binary.load(spark, f"{tmp_path}/{layout}", layout).count() == 0


def test_images_and_labels_by_ranges(spark, tmp_path):
    pixels = np.arange(40 * 4).astype(np.uint8)
    (tmp_path / "x").write_bytes(struct.pack(">IIII", 0x803, 40, 2, 2) + pixels.tobytes())
    (tmp_path / "y").write_bytes(struct.pack(">II", 0x801, 40) + bytes(range(40)))
    df = idx.read(spark, str(tmp_path / "x"), str(tmp_path / "y"), split=12)
    got = df.orderBy("id").collect()
    assert df.rdd.getNumPartitions() >= 10 and [r.label for r in got] == list(range(40))
    assert np.allclose([r.image for r in got], pixels.reshape(40, 4) / 255)
