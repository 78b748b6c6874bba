"""Patches to feature vectors, and fusion over two magnifications."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilesmith.functions import vectors

BATCH = 128


class Embedder(Protocol):
    """A model: load() once in each worker, then call on batches of (n, pixels) to (n, width) or (n, tokens, width)."""

    width: int

    def load(self) -> None: ...

    def __call__(self, batch: np.ndarray) -> np.ndarray: ...


class LinearEmbedder:
    """Deterministic stand-in for a network: W x with fixed weights, or those of a formula."""

    def __init__(self, inputs: int, width: int, weights: np.ndarray | None = None) -> None:
        self.width = width
        self.weights = weights if weights is not None else np.fromfunction(lambda i, j: ((7 * j + 11 * i) % 13 - 6) / 13, (width, inputs))

    def load(self) -> None:
        pass

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        return batch @ self.weights.T


class TorchEmbedder:
    """A network that is built by ``build()`` inside the worker; needs torch there."""

    def __init__(self, build, width: int, device: str = "cpu") -> None:
        self.build, self.width, self.device, self.model = build, width, device, None

    def load(self) -> None:
        try:
            import torch
        except ImportError as e:
            raise ImportError("this embedder needs torch on the executors") from e
        self.torch = torch
        self.model = self.build().eval().to(self.device)

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        with self.torch.no_grad():
            out = self.model(self.torch.from_numpy(batch).float().to(self.device))
        out = out[0] if isinstance(out, tuple) else out
        return out.cpu().numpy()


def placed(spark: SparkSession, tasks: TaskResourceRequests) -> ResourceProfile | None:
    """A profile for the stage of a model, e.g. placed(spark, TaskResourceRequests().resource("gpu", 0.5)); None on a master that has none, such as a local one."""
    if not spark.sparkContext.master.startswith(("spark://", "yarn", "k8s://", "local-cluster")):
        return None
    return ResourceProfileBuilder().require(tasks).build


def embedded(patches: DataFrame, embedder: Embedder, pixels: str = "pixels", batch: int = BATCH, profile: ResourceProfile | None = None) -> DataFrame:
    """patches with features array<double> and token_idx instead of its pixels.

    profile: resources that the model's stage asks for, and no other (see ``placed``).

    An Arrow mapper: whatever the size of Arrow's batches, the model sees at most ``batch`` rows
    at a time. A model with several tokens a patch gives a row for each, which keeps its patch's columns.
    """
    rest = [c for c in patches.columns if c not in (pixels, "features", "token_idx")]
    schema = T.StructType([*(patches.schema[c] for c in rest), T.StructField("token_idx", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder.load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                lists = part.column(len(rest))
                x = np.stack([np.asarray(v.as_py(), np.float64) for v in lists])
                out = np.asarray(embedder(x), np.float64)
                n = out.shape[1] if out.ndim == 3 else 1
                flat = out.reshape(len(x) * n, -1)
                own = part.select(range(len(rest))).take(pa.array(np.repeat(np.arange(len(x)), n)))
                ends = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.tile(np.arange(n, dtype=np.int32), len(x))), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], [*rest, "token_idx", "features"])

    return patches.select(*rest, pixels).mapInArrow(run, schema, profile=profile)


def token_rows(features: DataFrame, width: int) -> DataFrame:
    """One row for each token of a flat output, with the patch's columns and token_idx."""
    keep = [c for c in features.columns if c != "features"]
    return features.select(*keep, F.posexplode(vectors.tokens("features", width)).alias("token_idx", "features"))


def tree_features(high: DataFrame, low: DataFrame, keys: list[str], fusion: str = "cat") -> DataFrame:
    """High patches with features fused with those of their low patch: high has keys of its parent, low has them as its own.

    A low patch without children gives no row.
    """
    made = vectors.fused("features", "_low", fusion)
    return high.join(low.select(*keys, F.col("features").alias("_low")), keys).withColumn("features", made).drop("_low")
