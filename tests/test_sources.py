"""Clouds and point files: layouts, ranges and refusals."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathe.sources import point_files as pf
from swathe.sources import recordings as rec


def test_a_cloud_needs_no_intensity(spark):
    xyz = np.arange(9, dtype=np.float32).reshape(3, 3)
    rows = [(1, rec.build_cloud(xyz, 7, "a")), (2, rec.build_cloud(xyz, 7, "b", False)), (3, rec.build_cloud(xyz[:, :2], 7, "c")), (4, rec.build_cloud(xyz[:0], 7, "d")), (5, b"\0\2\0\0"), (6, b""), (7, rec.build_cloud(xyz, 7, "e")[:-1]), (8, None)]
    rows = [(i, None if b is None else bytearray(b)) for i, b in rows if b is not None]
    got = rec.decode_points(spark.createDataFrame(rows, "id long, data binary")).collect()
    fine = [(r["message_id"], r["x"], r["z"], r["intensity"], r["frame_id"]) for r in got if r["error"] is None]
    assert sorted(fine) == [(i, float(x), float(x + 2), None, f) for i, f in ((1, "a"), (2, "b")) for x in (0, 3, 6)]
    assert {r["message_id"]: r["error"] for r in got if r["error"]} == {3: "missing fields z", 5: "unsupported encapsulation", 6: "unsupported encapsulation", 7: "truncated cloud"}


def test_padding_and_fields_of_several_values():
    out = bytearray([0, 1, 0, 0]) + struct.pack("<iI", 1, 5) + struct.pack("<I", 2) + b"f\0" + b"\0\0" + struct.pack("<III", 2, 1, 4)
    for name, offset, code, n in (("x", 0, 7, 1), ("y", 4, 7, 1), ("z", 8, 7, 1), ("more", 12, 4, 2)):
        out += struct.pack("<I", 2 if len(name) == 1 else 5) + name.encode() + b"\0"
        out += b"\0" * (-(len(out) - 4) % 4) + struct.pack("<IB", offset, code)
        out += b"\0" * (-(len(out) - 4) % 4) + struct.pack("<I", n)
    out += struct.pack("<B", 0) + b"\0" * (-(len(out) + 1 - 4) % 4) + struct.pack("<III", 16, 20, 40)
    out += struct.pack("<3f2H4x", 1, 2, 3, 4, 5) + struct.pack("<3f2H4x", 6, 7, 8, 9, 10) + b"\1"
    cloud = rec.cloud_layout(bytes(out))
    assert (cloud.stamp_ns, cloud.frame_id, cloud.shape) == (1_000_000_005, "f", (2, 1))
    assert [rec.cloud_column(bytes(out), cloud, n).tolist() for n in ("x", "z", "more")] == [[1, 6], [3, 8], [4, 9]]


def test_ranges_of_a_file_are_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz = np.round(rng.uniform(-50, 50, (1050, 3)), 3)
    ring, time = rng.integers(0, 64, 1050).astype("<u1"), rng.uniform(0, 9, 1050)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.las").write_bytes(pf.build_las(xyz, 0.001, {"ring": ring, "sensor_timestamp": time, "point_index": np.arange(1050, dtype="<u8")[::-1].copy()}, np.arange(1050) % 999))
    (tmp_path / "b.las").write_bytes(pf.build_las(xyz[:3]))
    (tmp_path / "none.las").write_bytes(pf.build_las(xyz[:0]))
    (tmp_path / "other.txt").write_text("no points")
    got = pf.read_point_ranges(spark, str(tmp_path), 100).withColumn("task", F.spark_partition_id())
    a = got.where(F.col("path").endswith("a.las")).orderBy("point_row").toPandas()
    assert len(a) == 1050 and a["point_row"].tolist() == list(range(1050)) and a["task"].nunique() > 6
    assert np.allclose(a[["x", "y", "z"]].to_numpy(), xyz) and a["ring"].tolist() == ring.tolist() and np.allclose(a["time"], time)
    assert a["point_index"].tolist() == list(range(1050))[::-1] and a["intensity"].tolist() == (np.arange(1050) % 999).tolist()
    b = got.where(F.col("path").endswith("b.las")).orderBy("point_row").collect()
    assert [(r["ring"], r["point_index"], r["time"], r["frame_index"]) for r in b] == [(-1, i, None, None) for i in range(3)] and got.count() == 1053
    whole = pf.read_point_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.las").load(str(tmp_path)))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, got.drop("task").collect()), key=str)


@pytest.mark.parametrize(("change", "message"), [(lambda b: b"nope" + b[4:], "not a LAS file"), (lambda b: b[:104] + b"\x80" + b[105:], "compressed"), (lambda b: b[:-5], "truncated records"), (lambda b: b[:104] + b"\x0b" + b[105:], "unknown point format")])
def test_other_files_are_refused(spark, tmp_path, change, message):
    (tmp_path / "a.las").write_bytes(change(pf.build_las(np.ones((4, 3)))))
    with pytest.raises(Exception, match=message):
        pf.read_point_ranges(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match=message):
        pf.read_point_files(spark.read.format("binaryFile").load(str(tmp_path / "a.las"))).count()
