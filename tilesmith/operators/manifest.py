"""Bags, class labels and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilesmith.functions.paths import class_label


def bags(patches: DataFrame, keys: list[str]) -> DataFrame:
    return patches.select(*keys).distinct()


def bag_sizes(patches: DataFrame, keys: list[str]) -> DataFrame:
    return patches.groupBy(*keys).count()


def empty_bags(listed: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Bags that are listed but have no patch: to report, as they give no output rows."""
    return listed.join(patches.select(*keys), keys, "left_anti")


def with_ordinal(rows: DataFrame, class_col: str = "class_dir", name: str = "label_ordinal") -> DataFrame:
    """rows with the rank of their class among those present, from 0. Ranks come from the distinct classes, so rows aren't sorted."""
    ranks = rows.select(class_col).distinct().select(F.col(class_col).alias("_class"), (F.dense_rank().over(Window.orderBy(class_col)) - 1).cast("int").alias(name))
    return rows.join(ranks, rows[class_col].eqNullSafe(ranks["_class"])).drop("_class")


def with_labels(rows: DataFrame, class_col: str = "class_dir", strict: bool = True) -> DataFrame:
    """Both labels: the number in the directory's name, and its rank."""
    return with_ordinal(rows, class_col).withColumn("label_parsed", class_label(class_col, strict))


def united(*parts: DataFrame) -> DataFrame:
    """Manifests under one another by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def class_counts(manifest: DataFrame, label: str = "label") -> DataFrame:
    return manifest.groupBy(label).count()


def shuffled(manifest: DataFrame, seed: int = 0, key: str = "path") -> DataFrame:
    """In an order that a seed fixes."""
    return manifest.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
