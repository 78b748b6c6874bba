"""Settings of tiling and feature extraction, checked when they are made."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

BACKBONES = ("resnet18", "resnet34", "resnet50", "resnet101", "UNI2-h", "H-optimus-1", "Virchow2")
WIDTHS = {"resnet18": 512, "resnet34": 512, "resnet50": 2048, "resnet101": 2048, "UNI2-h": 1536, "H-optimus-1": 1536, "Virchow2": 2560}
MAGNIFICATIONS = ("single", "low", "high", "tree")


@dataclass(frozen=True)
class TilingConfig:
    dataset: str = "prognosis"
    input_dir: str = "data/raw_wsi"
    overlap: int = 0
    format: str = "jpeg"
    quality: int = 70
    tile_size: int = 224
    base_mag: float = 20
    magnifications: tuple[int, ...] = (0,)
    objective: float = 40
    background_t: float = 15

    def __post_init__(self) -> None:
        if not 1 <= len(self.magnifications) <= 2:
            raise ValueError("one or two magnification levels")
        if self.tile_size < 1 or self.overlap < 0:
            raise ValueError("tile_size must be positive, overlap not negative")
        object.__setattr__(self, "magnifications", tuple(sorted(self.magnifications)))

    @property
    def mode(self) -> str:
        return "pyramid" if len(self.magnifications) == 2 else "single"


@dataclass(frozen=True)
class FeatureConfig:
    num_classes: int = 2
    batch_size: int = 128
    backbone: str = "Virchow2"
    norm_layer: str = "instance"
    magnification: str = "single"
    weights: str | None = None
    weights_low: str | None = None
    weights_high: str | None = None
    tree_fusion: str = "cat"
    dataset: str = "TCGA-lung-single"

    def __post_init__(self) -> None:
        for value, known, name in ((self.backbone, BACKBONES, "backbone"), (self.norm_layer, ("instance", "batch"), "norm_layer"), (self.magnification, MAGNIFICATIONS, "magnification"), (self.tree_fusion, ("cat", "fusion", "add"), "tree_fusion")):
            if value not in known:
                raise ValueError(f"unknown {name} {value!r}: use one of {known}")
        if self.magnification == "tree" and not self.backbone.startswith("resnet"):
            raise NotImplementedError("tree features need a residual network backbone")
        own = (self.weights, self.weights_low, self.weights_high)
        if "ImageNet" in own and self.norm_layer != "batch":
            raise ValueError("ImageNet weights need norm_layer='batch'")
        if any(w in ("", "latest") for w in own):
            raise ValueError("weights must be named; no file is picked by listing order")
        if self.magnification == "tree" and "ImageNet" not in own and None in own[1:]:
            raise ValueError("tree features need weights_low and weights_high")

    @property
    def width(self) -> int:
        return WIDTHS[self.backbone]


#: Fixed value: entries at the end of a contrastive checkpoint that are its projection head's.
HEAD_ENTRIES = 4


def renamed(stored: Sequence[str], wanted: Sequence[str], head: int = HEAD_ENTRIES) -> dict[str, str]:
    """Names of a checkpoint's entries -> those of a network, by position, without the head at the checkpoint's end.

    Names don't matter, only their order. The shorter list ends the mapping: other entries of the network keep what they were
    made with. A checkpoint of a head alone, or repeated names, are refused.
    """
    body = list(stored)[: max(0, len(stored) - head)]
    if not body:
        raise ValueError(f"a checkpoint of {len(stored)} entries has none beside its head")
    if len(set(body)) < len(body) or len(set(wanted)) < len(wanted):
        raise ValueError("names of entries repeat")
    return dict(zip(body, wanted))
