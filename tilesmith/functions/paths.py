"""Identity from paths: class directory, slide, stem, tile position, labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def leaf(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent(path: Column | str) -> Column:
    """Directory above the leaf; null for a bare name."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def slide_name(path: Column | str) -> Column:
    """Leaf up to its first dot: a.b.svs is a."""
    return F.split(leaf(path), r"\.")[0]


def stem(path: Column | str) -> Column:
    """Leaf less its last extension."""
    return F.regexp_replace(leaf(path), r"\.[^.]*$", "")


def tile_position(name: Column | str) -> Column:
    """struct<col, row> of a patch name <col>_<row>.<ext>; null parts where it has another form."""
    own = stem(name)
    part = lambda i: F.nullif(F.regexp_extract(own, r"^(\d+)_(\d+)$", i), F.lit("")).cast("int")
    return F.struct(part(1).alias("col"), part(2).alias("row"))


def class_label(directory: Column | str, strict: bool = True) -> Column:
    """class_<n>[_...] is n, other names are -1. class_x stops the job, or is null if not strict."""
    number = F.split(_c(directory), "_")[1]
    return F.when(_c(directory).startswith("class_"), number.cast("int") if strict else number.try_cast("int")).otherwise(-1)


def has_extension(path: Column | str, *extensions: str) -> Column:
    """Case-sensitive, as globs are."""
    return _c(path).rlike(r"\.(?:" + "|".join(e.lstrip(".") for e in extensions) + r")$")


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slugify(text: Column | str, ascii_only: bool = False) -> Column:
    """Lower case, accents and other non-ASCII off, runs of anything else to one underscore.

    ascii_only: the input is known to be ASCII, so everything stays in the JVM.
    """
    lower = F.lower(_c(text))
    return F.regexp_replace(lower if ascii_only else _plain(lower), "[^a-z0-9]+", "_")
