"""Readers and writers of cell tables, image files and arrays."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from petriflow.schema import CELL_CSV

IMAGE = "path string, height int, width int, pixels array<double>"


def read_cells_csv(spark: SparkSession, path: str, schema: StructType = CELL_CSV) -> DataFrame:
    """Cell table from CSV with a header and a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_cells_dir(spark: SparkSession, path: str, schema: StructType = CELL_CSV) -> DataFrame:
    """A folder with a CSV for each time: `time` is the last number in a file's name, so names need no padding."""
    df = read_cells_csv(spark, path, schema)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumn("time", F.regexp_extract(name, r"(\d+)\D*$", 1).cast("int"))


def write_cells_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_time(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Parquet in folders by time, compressed."""
    df.repartition("time").write.mode("overwrite").option("compression", codec).partitionBy("time").parquet(path)


def save_labels(cells: DataFrame, labels: DataFrame, path: str) -> None:
    """Cells joined with their cluster (cell_id, label); cells without one are left out."""
    write_cells_csv(cells.drop("label").join(labels.where("label is not null"), "cell_id"), path)


_CLEAR, _STOP, _FIRST = 256, 257, 258


def lzw_decode(data: bytes) -> bytes:
    """Bytes of a TIFF strip of LZW codes: 9 to 12 bits each, highest bit first, widened one code early."""
    out, held, n, width, before = bytearray(), 0, 0, 9, b""
    table: list[bytes] = []
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == _STOP:
            break
        if code == _CLEAR:
            table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + word[:1])
        out += word
        before, width = word, min(12, (len(table) + 1).bit_length())
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """The codes that lzw_decode reads; time and memory grow with the length of the data alone."""
    out, held, n = bytearray(), _CLEAR, 9
    table: dict[int, int] = {}  # a word's code and the byte after it, to the code of both
    word, size = -1, _FIRST

    def put(code: int) -> None:
        nonlocal held, n
        width = size.bit_length()
        held, n = held << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(held >> n)
            held &= (1 << n) - 1

    for byte in data:
        if word < 0:
            word = byte
            continue
        at = word << 8 | byte
        longer = table.get(at)
        if longer is not None:
            word = longer
            continue
        put(word)
        table[at], word, size = size, byte, size + 1
        if size == 4094:
            put(_CLEAR)
            table, size = {}, _FIRST
    if word >= 0:
        put(word)
        size += 1
    put(_STOP)
    if n:
        out.append(held << (8 - n) & 255)
    return bytes(out)


def decode_tiff(raw: bytes) -> np.ndarray:
    """The image of a TIFF file, or the stack of its pages: strips or tiles, plain or LZW (with or without differences along rows),
    grey, 8 to 64 bits, integer or float."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not end or struct.unpack(end + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages = struct.unpack(end + "I", raw[4:8])[0], []
    while at:
        image, at = _page(raw, end, at)
        pages.append(image)
    return pages[0] if len(pages) == 1 else np.stack(pages)


#: Bytes of a value of each kind of tag, and the letters of those read as numbers.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_LETTERS = {1: "B", 3: "H", 4: "I"}


def _tags(raw: bytes, end: str, at: int) -> tuple[dict[int, tuple[int, int, bytes]], int]:
    """{tag: (kind, count, bytes)} of the page at `at`, and where the next one is told of."""
    tags, count = {}, struct.unpack(end + "H", raw[at : at + 2])[0]
    for i in range(count):
        entry = raw[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(end + "HHI", entry[:8])
        if kind in _SIZES:
            size = _SIZES[kind] * n
            where = struct.unpack(end + "I", entry[8:])[0]
            tags[tag] = kind, n, entry[8 : 8 + size] if size <= 4 else raw[where : where + size]
    after = at + 2 + 12 * count
    return tags, struct.unpack(end + "I", raw[after : after + 4])[0]


def _numbers(tags: dict[int, tuple[int, int, bytes]], end: str) -> dict[int, tuple]:
    return {t: struct.unpack(f"{end}{n}{_LETTERS[kind]}", data) for t, (kind, n, data) in tags.items() if kind in _LETTERS}


def _page(raw: bytes, end: str, at: int) -> tuple[np.ndarray, int]:
    """One page, and where the next one is told of."""
    found, after = _tags(raw, end, at)
    tags = _numbers(found, end)
    packing = tags.get(259, (1,))[0]
    if packing not in (1, 5) or not (273 in tags or 324 in tags):
        raise ValueError("only plain and LZW strips and tiles are read")
    if tags.get(277, (1,))[0] != 1:
        raise ValueError("only grey images are read")
    w, h, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
    starts, lengths = (tags[324], tags[325]) if 324 in tags else (tags[273], tags[279])
    pieces = [lzw_decode(raw[o : o + n]) if packing == 5 else raw[o : o + n] for o, n in zip(starts, lengths, strict=True)]
    letter = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    kind = np.dtype(f"{end}{letter}{bits // 8}")
    if 324 in tags:
        wide, high = tags[322][0], tags[323][0]
        across = -(-w // wide)
        tiles = [np.frombuffer(piece, kind, wide * high).reshape(high, wide) for piece in pieces]
        tiles = [np.cumsum(t, axis=1, dtype=t.dtype) for t in tiles] if tags.get(317, (1,))[0] == 2 else tiles
        return np.block([tiles[k : k + across] for k in range(0, len(tiles), across)])[:h, :w].astype(np.float64), after
    image = np.frombuffer(b"".join(pieces), kind, h * w).reshape(h, w)
    if tags.get(317, (1,))[0] == 2:
        image = np.cumsum(image, axis=1, dtype=image.dtype)
    return image.astype(np.float64), after


def encode_tiff(image: np.ndarray, lzw: bool = False, rows_each: int | None = None) -> bytes:
    """A grey TIFF of an image, or of a stack with a page for each, in its own numbers of 8 to 64 bits; rows_each: rows of a strip, all if not given."""
    pages = []
    for page in image if image.ndim == 3 else [image]:
        h, w = page.shape
        page = page.astype(np.dtype(page.dtype).newbyteorder("<"))
        step = rows_each or max(h, 1)
        strips = [page[k : k + step].tobytes() for k in range(0, h, step)]
        strips = [lzw_encode(x) for x in strips] if lzw else strips
        one = {256: w, 257: h, 258: page.dtype.itemsize * 8, 259: 5 if lzw else 1, 262: 1, 277: 1, 278: step, 339: {"u": 1, "i": 2, "f": 3}[page.dtype.kind]}
        pages.append(({t: (4, 1, struct.pack("<I", v)) for t, v in one.items()}, 273, strips))
    return _write_pages("<", pages)


def _write_pages(end: str, pages: list[tuple[dict[int, tuple[int, int, bytes]], int, list[bytes]]]) -> bytes:
    """A file of pages (tags, the tag of the pieces' places, pieces of data)."""
    out = bytearray((b"II" if end == "<" else b"MM") + struct.pack(end + "HI", 42, 0))
    link = 4

    def keep(data: bytes) -> int:
        at = len(out)
        out.extend(data + b"\0" * (len(data) % 2))
        return at

    for tags, place, pieces in pages:
        starts = [keep(x) for x in pieces]
        m = len(pieces)
        tags = tags | {place: (4, m, struct.pack(f"{end}{m}I", *starts)), {273: 279, 324: 325}[place]: (4, m, struct.pack(f"{end}{m}I", *map(len, pieces)))}
        rows = b""
        for tag, (kind, n, data) in sorted(tags.items()):
            rows += struct.pack(end + "HHI", tag, kind, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(end + "I", keep(data)))
        at = keep(struct.pack(end + "H", len(tags)) + rows + struct.pack(end + "I", 0))
        out[link : link + 4] = struct.pack(end + "I", at)
        link = at + 2 + len(rows)
    return bytes(out)


#: Tags that point to other places of a file, and one that turns the bits of bytes around: files with these stay as they are.
_POINTERS = {266, 288, 330, 347, 513, 514, 34665, 34853, 40965}


def pack_tiff(raw: bytes) -> bytes:
    """The file with its strips or tiles packed by LZW; every other tag, and so every page, number, colour and byte order, is as it was.

    A page packed in another way, or that LZW would make longer, keeps its data; a file that would not get shorter is returned as it is."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not end or struct.unpack(end + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages, seen = struct.unpack(end + "I", raw[4:8])[0], [], set()
    while at:
        if at in seen:
            raise ValueError("the pages of the file go round")
        seen.add(at)
        tags, at = _tags(raw, end, at)
        numbers = _numbers(tags, end)
        place, length = (324, 325) if 324 in numbers else (273, 279)
        if place not in numbers or length not in numbers or (_POINTERS - {266}) & tags.keys() or numbers.get(266, (1,))[0] != 1:
            return raw
        pieces = [raw[o : o + n] for o, n in zip(numbers[place], numbers[length], strict=True)]
        if numbers.get(259, (1,))[0] == 1:
            packed = [lzw_encode(x) for x in pieces]
            if sum(map(len, packed)) < sum(map(len, pieces)):
                tags, pieces = tags | {259: (3, 1, struct.pack(end + "H", 5))}, packed
        pages.append((tags, place, pieces))
    packed = _write_pages(end, pages)
    return packed if len(packed) < len(raw) else raw


def recompress(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(path, length, packed_length, packed): TIFF files packed anew by LZW without loss (pack_tiff), a file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    def pack(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                packed = pack_tiff(raw)
                yield pd.DataFrame({"path": [name], "length": [len(raw)], "packed_length": [len(packed)], "packed": [packed]})

    return files.select("path", "content").mapInPandas(pack, "path string, length long, packed_length long, packed binary")


def read_images(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(path, height, width, pixels) of TIFF or .npy files; NaN and infinite values become 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    def decode(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                img = np.load(io.BytesIO(raw), allow_pickle=False) if name.endswith(".npy") else decode_tiff(raw)
                img = np.nan_to_num(img.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
                if img.ndim > 2:  # channels of an array, or pages of a file
                    img = img.mean(axis=2 if name.endswith(".npy") else 0)
                yield pd.DataFrame({"path": [name], "height": [img.shape[0]], "width": [img.shape[1]], "pixels": [img.ravel().tolist()]})

    return files.select("path", "content").mapInPandas(decode, IMAGE)


def list_images(spark: SparkSession, path: str, wells: list[str] | None = None, channels: list[str] | None = None, pattern: str = "*.tif") -> DataFrame:
    """(path, length, well, day, step, channel), in order of well, day, step; names are <exp>_<well>_D#<day>_T<step>_<channel>.tif.

    Only names and sizes are read; filters apply before any content is."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    return parse_names(files, wells, channels)


def parse_names(files: DataFrame, wells: list[str] | None = None, channels: list[str] | None = None) -> DataFrame:
    part = lambda rx: F.nullif(F.regexp_extract("path", rx, 1), F.lit(""))
    out = files.withColumn("well", part(r"_([A-H]\d\d)_")).withColumn("day", part(r"D#(\d+)_T\d+").cast("int")).withColumn("step", part(r"D#\d+_T(\d+)").cast("int")).withColumn("channel", part(r"_(C\d+)\.\w+$"))
    if wells:
        out = out.where(F.col("well").isin(wells))
    if channels:
        out = out.where(F.col("channel").isin(channels))
    return out.orderBy("well", F.col("day").asc_nulls_last(), F.col("step").asc_nulls_last(), "channel", "path")


def to_pixels(images: DataFrame) -> DataFrame:
    """(path, r, c, v) rows of images."""
    e = images.select("path", "width", F.posexplode("pixels").alias("i", "v"))
    return e.select("path", F.floor(F.col("i") / F.col("width")).cast("int").alias("r"), (F.col("i") % F.col("width")).alias("c"), "v")


def compression_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files, bytes before and after, and the ratio."""
    a, b = (d.agg(F.count("*").alias(f"files_{n}"), F.sum("length").alias(f"bytes_{n}")) for d, n in ((before, "before"), (after, "after")))
    return a.join(b, F.lit(True)).withColumn("ratio", F.try_divide(F.col("bytes_after").cast("double"), F.col("bytes_before")))
