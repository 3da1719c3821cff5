"""GeoTIFF files as pixel tables, and back. Files are read block by block: each strip or tile of the file is a partition of its own.

Read: uncompressed, LZW, deflate, PackBits and (where its library is there) Zstandard, strips or tiles, either planar layout, integer and floating
samples, horizontal differencing and the floating-point predictor. Written: one strip per run of rows, deflate, with the grid's transform, coordinate
system and nodata; as BigTIFF where offsets need more than 32 bits.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.raster import Grid

# Fixed values of the TIFF format: sizes and codes of field types, and tag numbers.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, MATRIX, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113


def expand(inputs: str | Iterable[str], both: bool = True) -> list[str]:
    """Files, and the *.tif (and *.tiff) of folders in sorted order. Nothing found, or a path that isn't there, is an error."""
    out = []
    for path in [inputs] if isinstance(inputs, (str, os.PathLike)) else inputs:
        path = os.fspath(path)
        if os.path.isdir(path):
            ends = (".tif", ".tiff") if both else (".tif",)
            found = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ends))
            if not found:
                raise FileNotFoundError(f"No rasters in {path}")
            out += found
        elif os.path.exists(path):
            out.append(path)
        else:
            raise FileNotFoundError(path)
    if not out:
        raise ValueError("No raster inputs.")
    return out


@dataclass(frozen=True)
class Header:
    """Where a file's blocks are, and how their samples are kept."""

    grid: Grid
    bands: int
    dtype: str
    order: str
    compression: int
    predictor: int
    planar: int
    block: tuple[int, int]
    tiled: bool
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    geographic: bool = False


def header(path: str) -> Header:
    with open(path, "rb") as f:
        start = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None:
            raise ValueError(f"Not a TIFF file: {path}")
        big = struct.unpack(order + "H", start[2:4])[0] == 43
        at = struct.unpack(order + "Q", f.read(8))[0] if big else struct.unpack(order + "I", start[4:])[0]
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        entries = f.read(n * (20 if big else 12))
        tags = {}
        for k in range(n):
            raw = entries[k * (20 if big else 12) :][: 20 if big else 12]
            tag, kind = struct.unpack(order + "HH", raw[:4])
            count = struct.unpack(order + ("Q" if big else "I"), raw[4 : 12 if big else 8])[0]
            value, size = raw[12 if big else 8 :], _SIZES.get(kind, 0) * count
            if size > len(value):
                f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = f.read(size)
            if kind == 2:
                tags[tag] = value[:size].rstrip(b"\0").decode("latin-1")
            elif kind in _CODES:
                tags[tag] = struct.unpack(order + f"{count}{_CODES[kind]}", value[:size])
    one = lambda tag, otherwise: tags.get(tag, (otherwise,))[0]
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    number = codes.get(3072) or codes.get(2048)
    text = tags.get(NODATA)
    nodata = (float(text),) * bands if text and text.strip() else (None,) * bands
    tiled = TILE_OFFSETS in tags
    block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(height, one(ROWS_PER_STRIP, height)), width)
    return Header(
        Grid(width, height, transform, f"EPSG:{number}" if number and number != 32767 else None, nodata), bands, f"{kind}{one(BITS, 8) // 8}", order, one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1), block, tiled,
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], codes.get(1024) == 2 or (1024 not in codes and number == 4326),
    )


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, one bit longer a code early; 256 clears the table, 257 ends."""
    out, at, held, bits, size = bytearray(), 0, 0, 0, 9
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, last = list(start), b""
    while True:
        while bits < size:
            if at >= len(data):
                return bytes(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        bits -= size
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, last, size = list(start), b"", 9
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("A block's LZW codes are damaged.")
        own = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + own[:1])
        last = own
        out += own
        size = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression == 5:
        return _lzw(data)
    if compression == 50000:
        try:
            import zstandard
        except ImportError as why:
            raise ValueError("Reading Zstandard TIFF files needs the zstandard library.") from why
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 32773:
        out, at = bytearray(), 0
        while at < len(data):
            n = data[at]
            if n < 128:
                out += data[at + 1 : at + 2 + n]
                at += 2 + n
            else:
                if n > 128:
                    out += data[at + 1 : at + 2] * (257 - n)
                at += 2
        return bytes(out)
    raise ValueError(f"Unsupported TIFF compression: {compression}")


def read_block(path: str, h: Header, k: int) -> tuple[int, int, np.ndarray]:
    """The k-th block of the grid of blocks: its first row and column, and its values (rows, columns, bands)."""
    rows, cols = h.block
    across = -(-h.grid.width // cols)
    down = -(-h.grid.height // rows)
    r0, c0 = k // across * rows, k % across * cols
    planes = []
    with open(path, "rb") as f:
        for plane in range(h.bands if h.planar == 2 else 1):
            at = k + plane * across * down
            f.seek(h.offsets[at])
            data = _unpacked(f.read(h.counts[at]), h.compression)
            n = 1 if h.planar == 2 else h.bands
            have = rows if h.tiled else min(rows, h.grid.height - r0)
            kind = np.dtype(h.order + h.dtype)
            if h.predictor == 3:  # a row's bytes, most significant ones first, each as its difference from that of the sample before
                raw = np.frombuffer(data, np.uint8, have * cols * n * kind.itemsize).reshape(have, -1, n)
                raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(have, kind.itemsize, cols * n)
                a = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(have, cols, n)
            else:
                a = np.frombuffer(data, kind, have * cols * n).reshape(have, cols, n)
            if h.predictor == 2:
                a = np.cumsum(a, axis=1, dtype=a.dtype)
            elif h.predictor not in (1, 3):
                raise ValueError(f"Unsupported TIFF predictor: {h.predictor}")
            planes.append(a)
    out = np.concatenate(planes, axis=2)[: h.grid.height - r0, : h.grid.width - c0]
    return r0, c0, out


def read_array(path: str) -> tuple[np.ndarray, Header]:
    """A whole raster (rows, columns, bands)."""
    h = header(path)
    rows, cols = h.block
    blocks = -(-h.grid.width // cols) * -(-h.grid.height // rows)
    out = np.zeros((h.grid.height, h.grid.width, h.bands), np.dtype(h.dtype))
    for k in range(blocks):
        r, c, a = read_block(path, h, k)
        out[r : r + a.shape[0], c : c + a.shape[1]] = a
    return out, h


def write_array(path: str, values: np.ndarray, grid: Grid, big: bool = False) -> None:
    """A raster (rows, columns, bands) as a file; its folder is made. big: with 64-bit offsets in any case."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    height, width, bands = values.shape
    rows = max(1, min(height, 1_000_000 // max(1, width * bands * values.dtype.itemsize)))
    strips = [zlib.compress(np.ascontiguousarray(values[r : r + rows]).astype(values.dtype.newbyteorder("<")).tobytes()) for r in range(0, height, rows)]
    big = big or sum(map(len, strips)) > 2**32 - 2**24
    offsets = np.cumsum([16 if big else 8, *map(len, strips)]).tolist()
    wide, word, count, room = (16, "<Q", "<Q", 8) if big else (4, "<I", "<H", 4)
    a, b, x, d, e, y = map(float, grid.transform)
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [values.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8]), (262, 3, [1]), (STRIP_OFFSETS, wide, offsets[:-1]), (SAMPLES, 3, [bands]), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [1]), (FORMAT, 3, [kind] * bands)]
    tags += [(MATRIX, 12, [a, b, 0.0, x, d, e, 0.0, y, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    if grid.crs:
        n = int(grid.crs.split(":")[1])
        tags += [(GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if n == 4326 else 1, 1025, 0, 1, 1, 2048 if n == 4326 else 3072, 0, 1, n])]
    if grid.nodata and grid.nodata[0] is not None:
        tags += [(NODATA, 2, f"{grid.nodata[0]:g}".encode() + b"\0")]
    if bands > 1:
        tags += [(338, 3, [0] * (bands - 1))]
    at = offsets[-1] + offsets[-1] % 2
    more, entries = b"", b""
    for tag, code, value in sorted(tags, key=lambda t: t[0]):
        raw = value if code == 2 else struct.pack(f"<{len(value)}{_CODES[code]}", *value)
        if len(raw) > room:
            place = at + struct.calcsize(count) + (4 + 2 * room) * len(tags) + room + len(more)
            more += raw + b"\0" * (len(raw) % 2)
            own = struct.pack(word, place)
        else:
            own = raw.ljust(room, b"\0")
        entries += struct.pack("<HH", tag, code) + struct.pack(word, len(value)) + own
    with open(path, "wb") as out:
        out.write((b"II+\0" + struct.pack("<HH", 8, 0) if big else b"II*\0") + struct.pack(word, at))
        for strip in strips:
            out.write(strip)
        out.write(b"\0" * (offsets[-1] % 2) + struct.pack(count, len(tags)) + entries + b"\0" * room + more)


class RasterSource(DataSource):
    """spark.read.format("orbweave_raster").load(path): r, c, bands, one partition for each block of the file."""

    @classmethod
    def name(cls) -> str:
        return "orbweave_raster"

    def schema(self) -> str:
        return "r int, c int, bands array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RasterReader(self.options["path"])


class _RasterReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.header = path, header(path)

    def partitions(self) -> list[InputPartition]:
        rows, cols = self.header.block
        return [InputPartition(k) for k in range(-(-self.header.grid.width // cols) * -(-self.header.grid.height // rows))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        r0, c0, a = read_block(self.path, self.header, partition.value)
        h, w, n = a.shape
        r, c = np.divmod(np.arange(h * w), max(1, w))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1).astype(np.float64)), n).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array((r + r0).astype(np.int32)), pa.array((c + c0).astype(np.int32)), lists], ["r", "c", "bands"])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """A file's pixel table and grid."""
    spark.dataSource.register(RasterSource)
    return spark.read.format("orbweave_raster").load(path), header(path).grid


def write(pixels: DataFrame, path: str, grid: Grid, columns: Sequence[str], dtype: str) -> None:
    """Some columns of a pixel table as the bands of one file, for export: the raster is gathered on the driver. Larger results stay Parquet."""
    fill = grid.nodata[0] if grid.nodata and grid.nodata[0] is not None else 0
    out = np.full((grid.height, grid.width, len(columns)), fill, dtype)
    for batch in pixels.select("r", "c", *columns).toArrow().to_batches():
        r, c = batch.column("r").to_numpy(), batch.column("c").to_numpy()
        for k, name in enumerate(columns):
            v = batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            out[r, c, k] = np.where(np.isnan(v), fill, v) if not np.isnan(fill) and np.dtype(dtype).kind != "f" else v
    write_array(path, out, grid)
