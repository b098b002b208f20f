"""TIFF rasters: strips or tiles; none, deflate, LZW and PackBits compression; predictors 1 and 2; georeferencing tags.

A file is split by block ranges: the directory is read on the driver, and each task decodes its own blocks from the
file's bytes.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geoloom.model import Raster

#: Sizes and codes of tag types, and sample types by (format, bits).
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8", (1, 64): "u8", (2, 64): "i8", (3, 16): "f2"}
NAMES = {"u1": "Byte", "u2": "UInt16", "u4": "UInt32", "i1": "Int8", "i2": "Int16", "i4": "Int32", "f4": "Float32", "f8": "Float64", "u8": "UInt64", "i8": "Int64", "f2": "Float16"}


@dataclass(frozen=True)
class Directory:
    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default: object = None) -> object:
        return self.tags.get(tag, (default,))[0]

    @property
    def dtype(self) -> str:
        return DTYPES[(self.one(339, 1), self.one(258, 1))]


def directory(raw: bytes, level: int = 0) -> Directory:
    """The directory of the raster, or of one of the overviews that follow it in the file."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    magic = struct.unpack_from(order + "H", raw, 2)[0]
    big = magic == 43
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    for _ in range(level):
        n = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
        at = struct.unpack_from(order + ("Q" if big else "I"), raw, at + (8 + 20 * n if big else 2 + 12 * n))[0]
        if not at:
            raise ValueError(f"no overview {level}")
    n = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
    at += 8 if big else 2
    tags = {}
    for _ in range(n):
        tag, kind = struct.unpack_from(order + "HH", raw, at)
        count = struct.unpack_from(order + ("Q" if big else "I"), raw, at + 4)[0]
        place, room = (at + 12, 8) if big else (at + 8, 4)
        size = SIZES.get(kind, 1) * count
        if size > room:
            place = struct.unpack_from(order + ("Q" if big else "I"), raw, place)[0]
        if kind == 2:
            tags[tag] = (raw[place : place + count].rstrip(b"\0").decode("utf-8", "replace"),)
        elif kind in CODES:
            tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", raw, place)
        at += 20 if big else 12
    return Directory(order, tags)


def levels(raw: bytes) -> int:
    """How many overviews follow the raster."""
    n = 0
    while True:
        try:
            directory(raw, n + 1)
        except ValueError:
            return n
        n += 1


def _unpack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears, 257 ends."""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    out, width, bits, n, last = [], 9, 0, 0, None
    for byte in raw:
        bits, n = bits << 8 | byte, n + 8
        while n >= width:
            code = bits >> (n - width) & ((1 << width) - 1)
            n -= width
            bits &= (1 << n) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                del table[258:]
                width, last = 9, None
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            if last is not None:
                table.append(last + entry[:1])
                width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
            last = entry
    return b"".join(out)


def decode(raw: bytes, d: Directory, height: int, width: int, samples: int) -> np.ndarray:
    """A block as height x width x samples."""
    kind = d.one(259, 1)
    plain = {1: lambda b: b, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}.get(kind)
    if plain is None:
        raise ValueError(f"compression {kind} isn't supported")
    x = np.frombuffer(plain(raw), np.dtype(d.order + d.dtype))[: height * width * samples].reshape(-1, width, samples)
    if d.one(317, 1) == 2:
        x = np.cumsum(x, axis=1, dtype=x.dtype)
    return x


def read(spark: SparkSession, path: str, blocks_per_task: int = 16, level: int = 0) -> Raster:
    """A raster's cells (band, row, col, v); no-data values are null, and blocks that the file leaves out have no cells.

    One file: several are put together by a virtual raster or a mosaic. level: 0, or the number of an overview.
    """
    found = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} isn't one file")
    raw = bytes(found[0][0])
    d = directory(raw, level)
    w, h, n = d.one(256), d.one(257), d.one(277, 1)
    bw, bh = d.one(322, w), d.one(323, d.one(278, h))
    offsets, counts = d.tags.get(324, d.tags.get(273)), d.tags.get(325, d.tags.get(279))
    separate = d.one(284, 1) == 2
    across, down = -(-w // bw), -(-h // bh)
    nodata = float(d.one(42113)) if 42113 in d.tags else None
    gt = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if 33550 in d.tags and 33922 in d.tags:
        sx, sy, (i, j, _, x, y, _) = d.tags[33550][0], d.tags[33550][1], d.tags[33922][:6]
        gt = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    total = across * down * (n if separate else 1)
    tasks = spark.range(0, total, 1, max(1, -(-total // blocks_per_task)))
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for k, content in zip(b["id"].to_pylist(), b["content"].to_pylist(), strict=True):
                if not counts[k]:
                    continue
                plane, place = divmod(k, across * down)
                r0, c0 = place // across * bh, place % across * bw
                rows = min(bh, h - r0) if 324 not in d.tags else bh
                x = decode(content[offsets[k] : offsets[k] + counts[k]], d, rows, bw, 1 if separate else n)[: h - r0, : w - c0]
                r, c, s = np.meshgrid(np.arange(x.shape[0]) + r0, np.arange(x.shape[1]) + c0, np.arange(x.shape[2]) + plane + 1, indexing="ij")
                v = x.astype(np.float64).ravel()
                mask = np.isnan(v) if nodata is not None and np.isnan(nodata) else v == nodata if nodata is not None else None
                yield pa.RecordBatch.from_arrays([pa.array(s.ravel(), pa.int32()), pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), pa.array(v, mask=mask)], names=["band", "row", "col", "v"])

    # One file's bytes with each range of its blocks: a file is bounded by what a task can hold.
    from pyspark.sql import functions as F

    sent = tasks.join(F.broadcast(files)) if len(raw) < (8 << 20) else tasks.crossJoin(files)
    cells = sent.mapInArrow(run, "band int, row int, col int, v double")
    return Raster(cells, w, h, n, gt, None, NAMES[d.dtype], nodata)


def _tags(width: int, height: int, bands: int, dtype: np.dtype, tile: int, gt: tuple[float, ...] | None, nodata: float | None, reduced: bool) -> list[tuple[int, int, list]]:
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    out: list[tuple[int, int, list]] = [
        (254, 4, [1 if reduced else 0]), (256, 4, [width]), (257, 4, [height]), (258, 3, [dtype.itemsize * 8] * bands), (259, 3, [8]), (262, 3, [1]),
        (277, 3, [bands]), (284, 3, [2]), (322, 3, [tile]), (323, 3, [tile]), (339, 3, [kind] * bands),
    ]
    if gt and not reduced:
        out += [(33550, 12, [gt[1], -gt[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, gt[0], gt[3], 0.0])]
    if nodata is not None:
        out.append((42113, 2, list((repr(float(nodata)) + "\0").encode())))
    return out


def _directory_bytes(tags: list[tuple[int, int, list]], at: int, after: int, big: bool) -> bytes:
    """A directory at a place of the file; after: where the next one is, or 0."""
    tags = sorted(tags)
    head_size = (8 + 20 * len(tags) + 8) if big else (2 + 12 * len(tags) + 4)
    room, head, extra = 8 if big else 4, b"", b""
    for tag, t, v in tags:
        data = bytes(v) if t == 2 else struct.pack(f"<{len(v)}{CODES[t]}", *v)
        head += struct.pack("<HHQ" if big else "<HHI", tag, t, len(v))
        if len(data) <= room:
            head += data.ljust(room, b"\0")
        else:
            head += struct.pack("<Q" if big else "<I", at + head_size + len(extra))
            extra += data + b"\0" * (-len(data) % 8)
    return struct.pack("<Q" if big else "<H", len(tags)) + head + struct.pack("<Q" if big else "<I", after) + extra


def write(r: Raster, path: str, tile: int = 256, overviews: int = 0, big: bool | None = None) -> None:
    """A tiled, deflated TIFF: directories first (the raster, then its overviews by 2, 4, ...), then the tiles, those of the
    smallest overview first, so that readers of ranges find what they need at the front of the file.

    Tiles are put together and compressed in parallel and kept in the shared folder; the driver knows their sizes and
    streams them into the file, a partition at a time. Tiles without cells take no room. big: more than 4 GB; None: as needed.
    """
    from pyspark.sql import functions as F

    from geoloom.operators import raster, warp
    from geoloom.operators.components import cut_lineage

    from . import files

    spark = r.df.sparkSession
    dtype = np.dtype({v: k for k, v in NAMES.items()}[r.dtype])
    fill = float(r.nodata) if r.nodata is not None else 0.0
    levels = {0: r.df.select("band", "row", "col", "v")} | {k.bit_length() - 1: v for k, v in warp.pyramid(r.df, overviews).items()}
    parts = [df.select(F.lit(k).alias("level"), F.col("band").cast("int").alias("band"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), raster.store(F.col("v").cast("double"), r.dtype).alias("v")) for k, df in levels.items()]
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    cells = cells.filter("v is not null").withColumns({"ty": F.expr(f"cast(row div {tile} as int)"), "tx": F.expr(f"cast(col div {tile} as int)")})

    def packed(t: pa.Table) -> pa.Table:
        values = np.full((tile, tile), fill, dtype.newbyteorder("<"))
        values[t["row"].to_numpy() % tile, t["col"].to_numpy() % tile] = t["v"].to_numpy()
        body = zlib.compress(values.tobytes())
        first = [t[c][0].as_py() for c in ("level", "band", "ty", "tx")]
        return pa.table({**{c: pa.array([x], pa.int32()) for c, x in zip(("level", "band", "ty", "tx"), first, strict=True)}, "size": pa.array([len(body)], pa.int64()), "body": pa.array([body], pa.binary())})

    order = [F.desc("level"), "band", "ty", "tx"]
    tiles = cells.groupBy("level", "band", "ty", "tx").applyInArrow(packed, "level int, band int, ty int, tx int, size long, body binary")
    tiles = cut_lineage(tiles).orderBy(*order)
    sizes = [tuple(x) for x in tiles.select("level", "band", "ty", "tx", "size").collect()]  # the numbers that directories hold
    shape = {k: (-(-r.height // (1 << k)), -(-r.width // (1 << k))) for k in levels}
    total = sum(x[4] for x in sizes)
    if big is None:
        big = total + 64 * sum(-(-h // tile) * -(-w // tile) * r.bands for h, w in shape.values()) > 4_000_000_000
    wide = 16 if big else 4

    def layout(begin: int) -> tuple[bytes, int]:
        """All directories, when tiles begin at a place."""
        at, place = begin, {}
        for level, band, ty, tx, size in sizes:
            place[level, band, ty, tx] = (at, size)
            at += size
        head = struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8)
        out = b"II" + head
        for k in sorted(levels):
            h, w = shape[k]
            grid = [place.get((k, b, ty, tx), (0, 0)) for b in range(1, r.bands + 1) for ty in range(-(-h // tile)) for tx in range(-(-w // tile))]
            tags = _tags(w, h, r.bands, dtype, tile, r.gt, r.nodata, k > 0) + [(324, wide, [g[0] for g in grid]), (325, wide, [g[1] for g in grid])]
            here = len(out)
            alone = _directory_bytes(tags, here, 0, big)
            after = here + len(alone) if k < max(levels) else 0
            out += _directory_bytes(tags, here, after, big)
        return out, len(out)

    begin = layout(0)[1]
    fs, target = files._fs(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(layout(begin)[0])
        for row in tiles.select("body").toLocalIterator():
            stream.write(bytes(row["body"]))
    finally:
        stream.close()


def encode(values: np.ndarray, gt: tuple[float, ...] | None = None, nodata: float | None = None, compress: bool = True) -> bytes:
    """A little-endian TIFF of bands x height x width, a strip per 64 rows and band."""
    bands, h, w = values.shape
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    rows = 64
    strips = [values[b, r : r + rows].astype(values.dtype.newbyteorder("<")).tobytes() for b in range(bands) for r in range(0, h, rows)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    body, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(body))
        body += s
    text = (repr(nodata) + "\0").encode() if nodata is not None else b""
    tags: list[tuple[int, int, list]] = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [values.dtype.itemsize * 8] * bands), (259, 3, [8 if compress else 1]), (262, 3, [1]), (273, 4, offsets),
        (277, 3, [bands]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (284, 3, [2]), (339, 3, [kind] * bands),
    ]
    if gt:
        tags += [(33550, 12, [gt[1], -gt[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, gt[0], gt[3], 0.0])]
    if text:
        tags.append((42113, 2, list(text)))
    tags.sort()
    at = 8 + len(body)
    extra_at, extra, head = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, t, v in tags:
        data = bytes(v) if t == 2 else struct.pack(f"<{len(v)}{CODES[t]}", *v)
        head += struct.pack("<HHI", tag, t, len(v))
        if len(data) <= 4:
            head += data.ljust(4, b"\0")
        else:
            head += struct.pack("<I", extra_at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + head + b"\0\0\0\0" + extra


def to_array(df: DataFrame, height: int, width: int, bands: int = 1, dtype: str = "f8", nodata: float = 0.0) -> np.ndarray:
    """Cells as an array on the driver: for rasters that a single file holds."""
    out = np.full((bands, height, width), nodata, dtype)
    t = df.select("band", "row", "col", "v").toArrow()
    v = t["v"].to_numpy()
    ok = ~np.isnan(v)
    out[t["band"].to_numpy()[ok] - 1, t["row"].to_numpy()[ok], t["col"].to_numpy()[ok]] = v[ok]
    return out
