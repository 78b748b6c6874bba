"""Patch images, cohort tables, registers; feature, manifest, list and tile sinks. Bags as image files: ``bags``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilesmith.functions import paths, vectors
from tilesmith.sources import workbooks

IMAGES = ("jpg", "jpeg")
COHORT = "ESKD string, Mors string, Mors_year int, Transplant string, Dialysis string"
#: Of tables that bring the outcome and the first event themselves.
COHORT_WITH_OUTCOME = f"{COHORT}, RRT_or_death int, First_event_RRT_death int"
PATIENTS = "PasientID string, PersNummer string, EtterNavn string, ForNavn string"
REGISTER = "patient_id string, patient_fnr string"


def patch_images(spark: SparkSession, root: str, depth: str = "*/*", extensions: tuple[str, ...] = (*IMAGES, "png")) -> DataFrame:
    """(path, class_dir, slide_name, col, row, height, width, pixels array<int>, error): decoded in the JVM, put from BGR to RGB.

    An image that can't be decoded keeps its row, without pixels and with an error.

    depth: directories between root and the images: */* for bags, */*/* for the children of low patches. Images at other depths
    are left alone.
    """
    above = [x for x in spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().split("/") + depth.split("/") if x]
    images = spark.read.format("image").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").option("dropInvalid", False).load(f"{root}/{depth}")
    own = F.filter(F.split(F.regexp_replace("image.origin", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/"), lambda x: x != "")
    if root.startswith("/") or ":" in root:  # else the working directory comes before it
        images = images.where(F.size(own) == len(above) + 1)
    at = paths.tile_position("image.origin")
    up = F.split("image.origin", "/")

    @F.pandas_udf("array<int>")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.uint8).reshape(-1, c)[:, :3][:, ::-1].ravel().astype(np.int32) if c > 0 else None for d, c in zip(data, channels)])

    damaged = F.col("image.height") < 0
    known = lambda c: F.when(~damaged, F.col(c))

    return images.select(
        F.col("image.origin").alias("path"), F.element_at(up, -3).alias("class_dir"), paths.parent("image.origin").alias("slide_name"), at["col"].alias("col"), at["row"].alias("row"),
        known("image.height").alias("height"), known("image.width").alias("width"), rgb("image.data", "image.nChannels").alias("pixels"),
        F.when(damaged, F.lit("not an image")).alias("error"),
    )


def image_count(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGES) -> int:
    """Images below a directory; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    return files.select("path").count()


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV table with a header, UTF-8; columns by name, those that aren't in the schema are not read."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    there = {c.strip().lstrip("﻿"): c for c in raw.columns}
    return raw.select(*((F.col(f"`{there[f.name]}`").try_cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields))


def register(spark: SparkSession, path: str, schema: str = REGISTER) -> DataFrame:
    """A register from Parquet, CSV, or the first sheet of a workbook; columns by name. Old binary workbooks are refused."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".xls"):
        raise ValueError("save the old workbook as .xlsx, CSV or Parquet")
    if path.endswith(".xlsx"):
        return workbooks.sheet(spark, path, schema)
    return csv(spark, path, schema)


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long feature table by class; arrays stay arrays."""
    features.write.mode(mode).partitionBy("class_dir").parquet(path)


def export_features(features: DataFrame, path: str, width: int, label: str | None = "label", digits: int = 4) -> None:
    """Wide CSV for other tools, a directory for each class and slide: 0 .. width - 1 and the label last, fixed decimals, no index."""
    rounded = features.withColumn("features", F.transform("features", lambda v: F.bround(v.cast("double"), digits)))
    cells = [F.format_string(f"%.{digits}f", c).alias(str(i)) for i, c in enumerate(vectors.wide("features", width))]
    rows = rounded.select("class_dir", "slide_name", *cells, *([label] if label else []))
    rows.repartition("class_dir", "slide_name").write.mode("overwrite").partitionBy("class_dir", "slide_name").option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One small CSV of (0, label): a row for each bag."""
    manifest.select(F.col("path").alias("0"), "label").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_list(patients: DataFrame, path: str) -> None:
    patients.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_tiles(tiles: DataFrame, path: str, mode: str = "append") -> None:
    """Tiles with their pixels by class; the layout of bags is columns, so nothing is moved later."""
    tiles.write.mode(mode).partitionBy("class_dir").parquet(path)


def encoded(pixels: np.ndarray, extension: str, quality: int) -> bytes:
    if extension == "png":
        import struct
        import zlib

        def chunk(kind: bytes, data: bytes) -> bytes:
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        h, w, _ = pixels.shape
        rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
    from io import BytesIO

    from PIL import Image

    out = BytesIO()
    Image.fromarray(pixels).save(out, extension, quality=quality)
    return out.getvalue()
