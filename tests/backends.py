"""Backends that executors import by name."""

import numpy as np
from tilesmith.sources.slides import SyntheticBackend


class Counting:
    """Writes down what it is asked for, beside the slide."""

    def describe(self, path):
        with open(f"{path}.described", "a") as f:
            f.write("x\n")
        return SyntheticBackend().describe(path)

    def region(self, path, depth, x, y, *rest):
        with open(f"{path}.regions", "a") as f:
            f.write(f"{depth} {x} {y}\n")
        return SyntheticBackend().region(path, depth, x, y, *rest)


class Bounded(SyntheticBackend):
    def describe(self, path):
        return 1000, 800, {"openslide.bounds-x": "64", "openslide.bounds-y": "32", "openslide.bounds-width": "300"}


class Labelled(SyntheticBackend):
    """A label for each slide, and a macro that can't be read for some."""

    def associated(self, path):
        if "plain" in path:
            return
        yield "label", np.full((2, 3, 3), len(path), np.uint8)
        if "broken" in path:
            raise OSError("unreadable macro")
        yield "macro", np.zeros((4, 1, 3), np.uint8)
