"""Uncompressed LAS files: whole contents, or ranges of records read by many tasks."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# Fixed values of the format: record sizes without extra bytes by point format, places of the GPS time, types of extra bytes.
RECORD = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
GPS_TIME = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}
EXTRA = {1: "<u1", 2: "<i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
INTENSITY = 12
LAS = pa.schema([
    ("path", pa.string()), ("point_row", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("ring", pa.int16()), ("point_index", pa.int64()),
    ("intensity", pa.float64()), ("time", pa.float64()), ("frame_index", pa.int64()), ("source_frame_index", pa.int64()),
])
POINTS = "path string, point_row long, x double, y double, z double, ring short, point_index long, intensity double, time double, frame_index long, source_frame_index long"
RANGE = 1_000_000
# So many ranges have a task each; more are dealt out to as many tasks, or to one for every RANGE records.
TASKS = 512


@dataclass
class Layout:
    """Where the records of a file lie, and where each known dimension lies in a record."""

    first: int
    width: int
    count: int
    scale: np.ndarray
    offset: np.ndarray
    places: dict[str, tuple[int, str]]


def read_layout(head: bytes, path: str) -> Layout:
    """From the bytes in front of the records; fewer are refused."""
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError(f"{path}: not a LAS file")
    size, first, chunks = struct.unpack_from("<HII", head, 94)
    kind, width, count = struct.unpack_from("<BHI", head, 104)
    if kind & 0xC0:
        raise ValueError(f"{path}: compressed points are not read")
    if kind not in RECORD or width < RECORD[kind]:
        raise ValueError(f"{path}: unknown point format {kind} of {width} bytes")
    if head[25] >= 4:
        (count,) = struct.unpack_from("<Q", head, 247)
    if len(head) < first:
        raise ValueError(f"{path}: truncated header")
    places = {"intensity": (INTENSITY, "<u2")}
    if kind in GPS_TIME:
        places["gps_time"] = (GPS_TIME[kind], "<f8")
    at, place = size, RECORD[kind]
    for _ in range(chunks):
        owner, number, length = struct.unpack_from("<16sHH", head, at + 2)
        if owner.rstrip(b"\0") == b"LASF_Spec" and number == 4:
            for entry in range(at + 54, at + 54 + length, 192):
                code, options = head[entry + 2], head[entry + 3]
                name = head[entry + 4 : entry + 36].split(b"\0")[0].decode()
                if code in EXTRA:
                    places[name] = (place, EXTRA[code])
                place += int(EXTRA[code][2:]) if code in EXTRA else options if code == 0 else 0
        at += 54 + length
    return Layout(first, width, count, np.frombuffer(head, "<f8", 3, 131), np.frombuffer(head, "<f8", 3, 155), places)


def records(layout: Layout, raw: bytes, path: str, first_row: int) -> pa.RecordBatch:
    """Points of consecutive records; world coordinates are raw * scale + offset."""
    n = len(raw) // layout.width

    def read(place: int, kind: str, width: int = 1) -> np.ndarray:
        step = np.dtype(kind).itemsize
        return np.ndarray((n, width), kind, raw, place, (layout.width, step)) if n else np.zeros((0, width), kind)

    world = read(0, "<i4", 3) * layout.scale + layout.offset
    row = np.arange(first_row, first_row + n)

    def extra(names: tuple[str, ...], kind, default=None) -> pa.Array:
        for name in names:
            if name in layout.places:
                return pa.array(read(*layout.places[name])[:, 0].astype(kind))
        return pa.nulls(n, pa.from_numpy_dtype(kind)) if default is None else pa.array(default.astype(kind))

    columns = [
        pa.array([path] * n, pa.string()), pa.array(row), *(pa.array(np.ascontiguousarray(world[:, i])) for i in range(3)),
        extra(("ring",), np.int16, np.full(n, -1)), extra(("point_index",), np.int64, row), extra(("intensity_raw", "intensity"), np.float64),
        extra(("sensor_timestamp", "gps_time"), np.float64), extra(("frame_index",), np.int64), extra(("source_frame_index",), np.int64),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=LAS)


def read_point_files(files: DataFrame, batch: int = 500_000) -> DataFrame:
    """Points of LAS files given as (path, content), one task a file.

    Ring, point_index and other dimensions are the file's own, also where they
    are extra bytes (read as they stand, without their scale); without them the ring is -1,
    the index the row number, the others null. Compressed files are refused.
    """

    def run(batches):
        for b in batches:
            for path, blob in zip(b.column(0).to_pylist(), b.column(1)):
                raw = blob.as_py()
                layout = read_layout(raw, path)
                if len(raw) < layout.first + layout.count * layout.width:
                    raise ValueError(f"{path}: truncated records")
                for at in range(0, layout.count, batch):
                    lo = layout.first + at * layout.width
                    yield records(layout, raw[lo : lo + min(batch, layout.count - at) * layout.width], path, at)

    return files.select("path", "content").mapInArrow(run, POINTS)


def _opened(path: str):
    """The file by its full address, as Spark lists it."""
    system, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(at)


def _layout_of(path: str) -> Layout:
    with _opened(path) as f:
        head = f.read(375)
        return read_layout(head + f.read(max(0, struct.unpack_from("<I", head, 96)[0] - len(head))) if len(head) >= 227 else head, path)


def read_point_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Points of all LAS files below ``path``, read at most ``size`` records at a time.

    As ``read_point_files``, but no file is read as a whole: the driver lists
    names only, tasks read headers, and the ranges of records are dealt out
    anew, one a task while they are few. Tasks open the files through Arrow, which must know their file
    system; elsewhere ``read_point_files`` takes the contents from Spark.
    """

    def ranges(batches):
        for batch in batches:
            rows = []
            for name, length in zip(*(batch.column(i).to_pylist() for i in range(2))):
                layout = _layout_of(name)
                if length < layout.first + layout.count * layout.width:
                    raise ValueError(f"{name}: truncated records")
                rows += [(name, lo, min(size, layout.count - lo)) for lo in range(0, layout.count, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], ["path", "lo", "n"])

    def read(batches):
        for batch in batches:
            for name, lo, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                layout = _layout_of(name)
                with _opened(name) as f:
                    f.seek(layout.first + lo * layout.width)
                    yield records(layout, f.read(n * layout.width), name, lo)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.las").load(path).select("path", "length")
    found = cut(files.mapInArrow(ranges, "path string, lo long, n long"), "ranges")
    # Whatever little the list itself weighs: a number given here isn't coalesced.
    seen = found.agg(F.count(F.lit(1)).alias("ranges"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")).first()
    tasks = min(seen["ranges"], max(TASKS, -(-seen["records"] // RANGE)))
    return found.repartition(max(1, tasks)).mapInArrow(read, POINTS)


def build_las(xyz: np.ndarray, scale: float = 0.001, extra: dict[str, np.ndarray] | None = None, intensity: np.ndarray | None = None) -> bytes:
    """A LAS 1.2 file of point format 0; ``extra`` holds further dimensions as extra bytes."""
    extra = extra or {}
    codes = {np.dtype(v): k for k, v in EXTRA.items()}
    entries, place, fields = b"", RECORD[0], {"xyz": ((("<i4"), (3,)), 0), "intensity": ("<u2", INTENSITY)}
    for name, values in extra.items():
        kind = np.asarray(values).dtype.newbyteorder("<")
        entry = bytearray(192)
        entry[2] = codes[kind]
        entry[4 : 4 + len(name)] = name.encode()
        entries += bytes(entry)
        fields[name] = (kind, place)
        place += kind.itemsize
    chunk = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(entries), b"") + entries if extra else b""
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227 + len(chunk), 1 if extra else 0)
    struct.pack_into("<BHI", head, 104, 0, place, len(xyz))
    struct.pack_into("<3d", head, 131, *[scale] * 3)
    struct.pack_into("<3d", head, 155, 0.0, 0.0, 0.0)
    rows = np.zeros(len(xyz), np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [p for _, p in fields.values()], "itemsize": place}))
    rows["xyz"] = np.rint(np.asarray(xyz) / scale).astype(np.int32)
    for name, values in (extra | ({"intensity": intensity} if intensity is not None else {})).items():
        rows[name] = values
    return bytes(head) + chunk + rows.tobytes()
