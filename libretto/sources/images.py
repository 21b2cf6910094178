"""Format and size of images from their first bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from libretto.functions.scores import cover_score

#: Markers of a JPEG frame header: those that carry the picture's size.
FRAMES = frozenset({*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC})


HEADER = StructType([StructField("image_format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())])


def inspect(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height); unknown parts are null."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return ("png", *struct.unpack(">II", data[16:24])) if len(data) >= 24 else ("png", None, None)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X" and len(data) >= 30:
            return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8 " and len(data) >= 30:
            w, h = struct.unpack("<HH", data[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF
        if kind == b"VP8L" and len(data) >= 25:
            bits = int.from_bytes(data[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return "webp", None, None
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in FRAMES:
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return "jpeg", None, None
    return None, None, None


@F.pandas_udf(HEADER)
def image_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inspect(c) for c in content], columns=["image_format", "width", "height"]).astype({"width": "Int64", "height": "Int64"})


def read_covers(spark, path: str) -> DataFrame:
    """(source_url, image_format, width, height, file_size, quality_score) of the image files below a path."""
    files = spark.read.format("binaryFile").load(path)
    seen = files.select(F.col("path").alias("source_url"), F.col("length").cast("int").alias("file_size"), image_header("content").alias("i")).select("source_url", "file_size", "i.*")
    score: Column = cover_score(F.col("width"), F.col("height"), F.col("file_size"))
    return seen.withColumn("quality_score", F.when(F.col("image_format").isNull(), 0.0).otherwise(score))


def local_path(cover_id: Column, image_format: Column, folder: str = "covers") -> Column:
    return F.concat(F.lit(folder + "/"), cover_id, F.lit("."), F.coalesce(image_format, F.lit("jpg")))
