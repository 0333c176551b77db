"""Binary map extracts as a Spark data source: spark.read.format("map_pbf").option("kinds", "node,way").load(path).

The driver reads block headers alone; blocks are grouped into partitions by size, and each is decoded where it is read,
packed numbers by arrays. The path is a local or shared folder's, or a URI that pyarrow.fs knows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, tags map<string,string>, lat double, lon double, refs array<long>, members array<struct<type:string,ref:long,role:string>>"
_ARROW = pa.schema(
    [("kind", pa.string()), ("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])))]
)
#: Compressed bytes of a partition; a block on its own may be larger.
PARTITION_BYTES = 16 << 20
# Fixed values of the format: features a reader must know, and member types.
KNOWN = {"OsmSchema-V0.6", "DenseNodes"}
MEMBER = ["node", "way", "relation"]


def fields(buf):
    """(number, value) of a message: integers of varints, memory of the rest."""
    i, n = 0, len(buf)

    def number():
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < n:
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        elif kind in (1, 2, 5):
            size = number() if kind == 2 else 8 if kind == 1 else 4
            value, i = buf[i : i + size], i + size
            if i > n:
                raise ValueError("message cut short")
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(buf) -> np.ndarray:
    """Packed varints."""
    b = np.frombuffer(buf, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    at = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b[: ends[-1] + 1] & 127).astype(np.uint64) << (at * 7).astype(np.uint64), starts)


def signed(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)


def _int(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _one_signed(v: int) -> int:
    return v >> 1 ^ -(v & 1)


def inflate(blob) -> bytes:
    for n, v in fields(blob):
        if n == 1:
            return bytes(v)
        if n == 3:
            return zlib.decompress(v)
        if n == 7:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(bytes(v), max_output_size=1 << 26)
        if n in (4, 5, 6):
            raise ValueError("compression not supported")
    return b""


def block_rows(data: bytes, kinds: set[str]) -> list[tuple]:
    """Rows of one primitive block, in file order."""
    strings, groups, step, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(memoryview(data)):
        if n == 1:
            strings = [bytes(s).decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            step = v
        elif n == 19:
            lat0 = _int(v)
        elif n == 20:
            lon0 = _int(v)
    degrees = lambda raw, zero: (zero + step * raw) / 1e9
    pairs = lambda m: [(strings[a], strings[b]) for a, b in zip(packed(m.get(2, b"")), packed(m.get(3, b"")), strict=True)]
    out = []
    for g in groups:
        for n, v in fields(g):
            if n == 1 and "node" in kinds:
                m = dict(fields(v))
                out.append(("node", _one_signed(m.get(1, 0)), pairs(m), degrees(_one_signed(m.get(8, 0)), lat0), degrees(_one_signed(m.get(9, 0)), lon0), None, None))
            elif n == 2 and "node" in kinds:
                m = dict(fields(v))
                ids, lat, lon = (np.cumsum(signed(packed(m.get(k, b"")))) for k in (1, 8, 9))
                kv = packed(m.get(10, b"")).astype(np.int64)
                tags: list[list] = [[] for _ in ids]
                ends = np.flatnonzero(kv == 0)
                for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1] + 1)), ends, strict=True) if len(ends) else ()):
                    if b > a:
                        tags[i] = [(strings[x], strings[y]) for x, y in zip(kv[a:b:2], kv[a + 1 : b : 2], strict=True)]
                out += [("node", *x, None, None) for x in zip(ids.tolist(), tags, degrees(lat, lat0).tolist(), degrees(lon, lon0).tolist(), strict=True)]
            elif n == 3 and "way" in kinds:
                m = dict(fields(v))
                out.append(("way", _int(m.get(1, 0)), pairs(m), None, None, np.cumsum(signed(packed(m.get(8, b"")))).tolist(), None))
            elif n == 4 and "relation" in kinds:
                m = dict(fields(v))
                own = zip(packed(m.get(10, b"")), np.cumsum(signed(packed(m.get(9, b"")))).tolist(), packed(m.get(8, b"")), strict=True)
                out.append(("relation", _int(m.get(1, 0)), pairs(m), None, None, None, [{"type": MEMBER[int(t)], "ref": r, "role": strings[s]} for t, r, s in own]))
    return out


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def blocks(f):
    """(type, offset, size) of the blobs of a file, by their headers."""
    while True:
        head = f.read(4)
        if not head:
            return
        if len(head) < 4:
            raise ValueError("file cut short")
        h = dict(fields(f.read(struct.unpack(">I", head)[0])))
        size, at = h[3], f.tell()
        yield bytes(h[1]).decode(), at, size
        f.seek(at + size)


class _Part(InputPartition):
    def __init__(self, own):
        self.own = own


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.kinds = {x.strip() for x in (options.get("kinds") or "node,way,relation").split(",")}
        self.most = int(options.get("partitionBytes") or PARTITION_BYTES)
        if not self.path or self.kinds - set(MEMBER):
            raise ValueError("path and kinds of node, way, relation are expected")

    def partitions(self):
        parts, own, held = [], [], 0
        with _open(self.path) as f:
            for kind, at, size in list(blocks(f)):
                if kind == "OSMHeader":
                    f.seek(at)
                    missing = {bytes(v).decode() for n, v in fields(inflate(f.read(size))) if n == 4} - KNOWN
                    if missing:
                        raise ValueError(f"features not supported: {sorted(missing)}")
                elif kind == "OSMData":
                    if own and held + size > self.most:
                        parts, own, held = [*parts, _Part(own)], [], 0
                    own.append((at, size))
                    held += size
        return [*parts, _Part(own)] if own or not parts else parts

    def read(self, partition):
        with _open(self.path) as f:
            for at, size in partition.own:
                f.seek(at)
                rows = block_rows(inflate(f.read(size)), self.kinds)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class PbfSource(DataSource):
    @classmethod
    def name(cls):
        return "map_pbf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, path: str, kinds: str = "node,way,relation"):
    spark.dataSource.register(PbfSource)
    return spark.read.format("map_pbf").option("kinds", kinds).load(path)
