"""File formats: netpbm and PNG images, IDX arrays, text arrays, box files, word lists and hOCR."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Magic bytes of the public formats.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PIXELS = "path string, page int, x int, y int, v int"


def sniff(content):
    """pnm, png, jpeg or tiff by the first bytes; else null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.rlike("^503[1-6]"), "pnm").when(head == "89504E47", "png").when(head.startswith("FFD8"), "jpeg").when(head.isin("49492A00", "4D4D002A"), "tiff")


def by_extension(path): return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def decode_pnm(data: bytes) -> np.ndarray:
    """Height x width x channels, 0..255; bitmaps have 255 for white."""
    kind, at, values = data[1] - 48, 2, []
    while len(values) < (2 if kind in (1, 4) else 3):
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            values.append(int(data[at:end]))
            at = end
    w, h, top = (*values, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w]
        return ((1 - bits) * 255)[:, :, None]
    if kind == 1:
        return ((1 - np.array([int(c) for c in data[at:].decode() if c in "01"]).reshape(h, w)) * 255)[:, :, None]
    if kind in (2, 3):
        x = np.array(data[at:].split(), dtype=np.int64)
    else:
        x = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * channels, at + 1).astype(np.int64)
    return x[: w * h * channels].reshape(h, w, channels) * 255 // top


def encode_pnm(x: np.ndarray) -> bytes:
    h, w = x.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if x.ndim == 3 and x.shape[2] == 3 else 5, w, h) + x.astype(np.uint8).tobytes()


def decode_png(data: bytes) -> np.ndarray:
    """8-bit gray, RGB, with or without alpha, and palette images, not interlaced."""
    at, packed, palette = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += n + 12
    if interlace or depth not in (1, 2, 4, 8):
        raise ValueError("interlaced and 16-bit images are not read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, step = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, stride + 1)
    out = np.zeros((h + 1, stride + step), dtype=np.int64)
    for y in range(h):
        filt, line, up, now = raw[y, 0], raw[y, 1:].astype(np.int64), out[y], out[y + 1]
        if filt == 0:
            now[step:] = line
        elif filt == 2:
            now[step:] = (line + up[step:]) & 255
        elif filt == 1:
            for c in range(step):
                now[step + c :: step] = np.cumsum(line[c::step]) & 255
        else:
            for k in range(stride):
                a, b, c = int(now[k]), int(up[k + step]), int(up[k])
                if filt == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[k + step] = (line[k] + guess) & 255
    x = out[1:, step:].astype(np.uint8)
    if depth < 8:
        x = np.unpackbits(x, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1])
        x = x[:, :w] if colour == 3 else x[:, :w] * 255 // ((1 << depth) - 1)
    x = x.reshape(h, w, channels)
    return palette[x[:, :, 0]] if colour == 3 else x[:, :, : 1 if channels < 3 else 3]


def encode_png(x: np.ndarray) -> bytes:
    h, w = x.shape[:2]
    flat = x.astype(np.uint8).reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate((np.zeros((h, 1), np.uint8), flat), axis=1).tobytes()
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if flat.shape[1] == 3 * w else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def gray(x: np.ndarray) -> np.ndarray:
    return x[:, :, 0] if x.shape[2] == 1 else x.astype(np.int64).sum(2) // 3


def pixels(files: DataFrame) -> DataFrame:
    """Gray pixels of image files read by Spark's binaryFile source; one row for each pixel."""

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                x = gray(decode_png(data) if data[:8] == PNG_MAGIC else decode_pnm(data))
                h, w = x.shape
                for y in range(0, h, 256):
                    part = x[y : y + 256]
                    yield pd.DataFrame({"path": path, "page": 0, "x": np.tile(np.arange(w), len(part)), "y": np.repeat(np.arange(y, y + len(part)), w), "v": part.ravel()})

    return files.select("path", "content").mapInPandas(run, PIXELS)


def images(df: DataFrame, png: bool = True) -> DataFrame:
    """(img, content): one encoded file for each image of a pixel table (img, x, y, v); an image fits one task."""

    def run(key, pdf):
        x = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), dtype=np.uint8)
        x[pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({"img": [key[0]], "content": [encode_png(x) if png else encode_pnm(x)]})

    return df.groupBy("img").applyInPandas(run, "img long, content binary")


def decode_idx(data: bytes) -> np.ndarray:
    kinds = {8: ">u1", 9: ">i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}
    kind, rank = data[2], data[3]
    return np.frombuffer(data, kinds[kind], offset=4 + 4 * rank).reshape(struct.unpack_from(f">{rank}I", data, 4))


def encode_idx(x: np.ndarray) -> bytes:
    kind = {"u1": 8, "i1": 9, "i2": 11, "i4": 12, "f4": 13, "f8": 14}[x.dtype.str[1:]]
    return bytes([0, 0, kind, x.ndim]) + struct.pack(f">{x.ndim}I", *x.shape) + x.astype(x.dtype.newbyteorder(">")).tobytes()


def idx_rows(files: DataFrame) -> DataFrame:
    """(path, row, features) of IDX files: the leading dimension becomes rows."""

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                x = decode_idx(data)
                x = x.reshape(len(x), -1).astype(np.float32)
                yield pd.DataFrame({"path": path, "row": np.arange(len(x)), "features": list(x)})

    return files.select("path", "content").mapInPandas(run, "path string, row long, features array<float>")


def array_to_text(a): return F.concat(F.size(a).cast("string"), F.lit("\n"), F.concat_ws("\n", a.cast("array<string>")))
def text_to_array(s): return F.slice(F.split(s, "\n"), 2, 1 << 30).cast("array<double>")
def parse_vector(s): return F.expr(f"transform(split(trim({s}), '\\\\s+'), x -> try_cast(x as double))")
def read_boxes(spark: SparkSession, path: str) -> DataFrame: return spark.read.csv(path, sep=" ", schema="symbol string, x0 int, y0 int, x1 int, y1 int")
def read_words(spark: SparkSession, path: str) -> DataFrame: return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()
def write_costs(df: DataFrame, path: str) -> None: df.select("idx", "cost").write.csv(path, sep=" ")


def hocr_line(line, text, x0, y0, x1, y1, height):
    """A line's span; y counts from the top in the title."""
    return F.format_string("<span class='ocr_line' id='line_%d' title='bbox %d %d %d %d'>%s</span>", line, x0, height - y1, x1, height - y0, text)


def hocr_page(df: DataFrame) -> DataFrame:
    """(page, html) from (page, line, html), lines in order."""
    return df.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "html"))), lambda s: s["html"]), "").alias("html"))
