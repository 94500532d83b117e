"""Pictures as files: written by tasks under their digests, found again by path."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(pixels: np.ndarray) -> bytes:
    """A grey picture of 16-bit depth (rows x columns, 0 to 65,535), unfiltered."""
    rows = pixels.astype(">u2")
    lines = b"".join(b"\0" + row.tobytes() for row in rows)
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 16, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def pixels_of(data: bytes) -> np.ndarray:
    """The pixels of a picture that ``png`` wrote; any other is refused."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, body, head = len(SIGNATURE), b"", None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("a chunk is damaged")
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    width, height, *rest = head
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 2 * width)
    if rest != [16, 0, 0, 0, 0] or lines[:, 0].any():
        raise ValueError("only unfiltered grey pictures of 16 bits")
    return np.ascontiguousarray(lines[:, 1:]).view(">u2").astype(np.int64)


def write_pictures(df: DataFrame, key: str, pixels: str, width: str, folder: str) -> DataFrame:
    """(key, sha1, path): every picture as ``folder/ab/abcdef....png`` under its digest.

    Tasks write beside the final name and move the file onto it, so a file is whole or absent and a task that runs again, or
    a copy of the picture, puts the same bytes there.  Values are rounded and kept within 16 bits.  ``folder`` is one that
    pyarrow's file systems open.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for k, p, w in zip(batch["k"], batch["p"], batch["w"]):
                data = png(np.clip(np.rint(np.asarray(p, float)), 0, 65535).reshape(-1, int(w)))
                name = hashlib.sha1(data).hexdigest()
                place = f"{name[:2]}/{name}.png"
                system.create_dir(f"{root}/{name[:2]}", recursive=True)
                beside = f"{root}/{name[:2]}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as out:
                    out.write(data)
                system.move(beside, f"{root}/{place}")
                rows.append((k, name, place))
            yield pd.DataFrame(rows, columns=["k", "sha1", "path"])

    out = df.select(F.col(key).alias("k"), F.col(pixels).alias("p"), F.col(width).alias("w")).mapInPandas(run, "k long, sha1 string, path string")
    return out.withColumnRenamed("k", key)


def read_pictures(spark: SparkSession, folder: str, prefixes: str = "*") -> DataFrame:
    """(sha1, pixels, width) of the files whose folders match ``prefixes``: other folders are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(f"{folder}/{prefixes}")

    @F.pandas_udf("pixels array<double>, width int")
    def decode(contents: pd.Series) -> pd.DataFrame:
        found = [pixels_of(c) for c in contents]
        return pd.DataFrame({"pixels": [p.ravel().astype(float) for p in found], "width": [p.shape[1] for p in found]})

    return files.select(F.regexp_extract("path", r"([0-9a-f]{40})\.png$", 1).alias("sha1"), decode("content").alias("d")).select("sha1", "d.*")


def rounded(pixels: Column) -> Column:
    """Pixel values as a file keeps them."""
    return F.transform(pixels, lambda x: F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(65535.0)))
