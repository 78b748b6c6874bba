"""Newly arrived slides, as a stream that runs over what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesmith.functions import paths
from tilesmith.sources.slides import SLIDES


def arriving(spark: SparkSession, input_dir: str, extensions: tuple[str, ...] = SLIDES, files_per_trigger: int = 10_000) -> DataFrame:
    """A stream of (path, length, modificationTime, class_dir, slide_name); contents are not read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True)
    files = files.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").option("maxFilesPerTrigger", files_per_trigger).load(input_dir)
    return files.select("path", "length", "modificationTime", paths.parent("path").alias("class_dir"), paths.slide_name("path").alias("slide_name"))


def ingest(spark: SparkSession, input_dir: str, table: str, checkpoint: str) -> int:
    """Append slides that weren't seen before to a Parquet table; each exactly once over restarts. Gives the number of rows there."""
    q = arriving(spark, input_dir).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(table).agg(F.count("*")).first()[0]
