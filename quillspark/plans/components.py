"""Component registry: constructors by name, typed parameters, save and load as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import images, learning, profiles


class Binarizer(Protocol):
    def __call__(self, pixels: DataFrame) -> DataFrame: ...


class Classifier(Protocol):
    def fit(self, x, y): ...
    def classify(self, x): ...


class PageSegmenter(Protocol):
    def __call__(self, pixels: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ThresholdBinarizer:
    threshold: int = 128

    def __call__(self, pixels): return images.binarize(pixels, self.threshold)


@dataclass(frozen=True)
class RangeBinarizer:
    fraction: float = 0.5

    def __call__(self, pixels): return images.binarize_range(pixels, self.fraction)


@dataclass(frozen=True)
class SauvolaBinarizer:
    radius: int = 7
    k: float = 0.3

    def __call__(self, pixels): return images.sauvola(pixels, self.radius, self.k)


@dataclass(frozen=True)
class ProfilePageSegmenter:
    """One column; lines are the islands of the row projection."""

    low: int = 1
    high: int = 20

    def __call__(self, pixels): return profiles.profile_islands(images.projection(pixels, "y"), self.low, self.high)


@dataclass(frozen=True)
class ProfileLineSegmenter:
    low: int = 1
    high: int = 5

    def __call__(self, pixels): return profiles.profile_islands(images.projection(pixels, "x"), self.low, self.high)


@dataclass(frozen=True)
class ComponentSegmenter:
    eight: bool = False

    def __call__(self, pixels): return images.label_components(pixels, self.eight)


@dataclass(frozen=True)
class PerceptronClassifier:
    hidden: int = 24
    rate: float = 0.5
    epochs: int = 40
    seed: int = 7

    def fit(self, x, y): return learning.Perceptron(self.hidden, self.rate, self.epochs, self.seed).fit(x, y)


@dataclass(frozen=True)
class BoostedClassifier:
    rounds: int = 5

    def fit(self, x, y): return learning.Boosting(self.rounds).fit(x, y)


_REGISTRY: dict[str, tuple[str, Callable[..., Any]]] = {}


def register(name: str, interface: str, constructor: Callable[..., Any]) -> None:
    if name in _REGISTRY and _REGISTRY[name][1] is not constructor:
        raise ValueError(f"{name} is taken")
    _REGISTRY[name] = (interface, constructor)


def construct(name: str, **parameters: Any) -> Any:
    if name not in _REGISTRY:
        raise KeyError(f"no component {name}")
    return _REGISTRY[name][1](**parameters)


def names(interface: str | None = None) -> list[str]:
    return sorted(n for n, (i, _) in _REGISTRY.items() if interface in (None, i))


def parameters(component: Any) -> dict[str, Any]:
    return asdict(component)


def with_parameter(component: Any, name: str, value: Any) -> Any:
    """A copy with one parameter set; an unknown name is an error."""
    if name not in {f.name for f in fields(component)}:
        raise KeyError(name)
    return replace(component, **{name: value})


def save(component: Any) -> str:
    name = next(n for n, (_, c) in _REGISTRY.items() if c is type(component))
    return json.dumps({"component": name, "parameters": parameters(component)}, sort_keys=True)


def load(text: str) -> Any:
    d = json.loads(text)
    return construct(d["component"], **d["parameters"])


def listing(spark: SparkSession) -> DataFrame:
    """(name, interface, parameter, value) of every component's defaults."""
    rows = [(n, i, k, json.dumps(v)) for n, (i, c) in sorted(_REGISTRY.items()) for k, v in parameters(c()).items()]
    return spark.createDataFrame(rows, "name string, interface string, parameter string, value string")


for _name, _interface, _constructor in (
    ("threshold", "binarizer", ThresholdBinarizer), ("range", "binarizer", RangeBinarizer), ("sauvola", "binarizer", SauvolaBinarizer),
    ("profile_page", "page_segmenter", ProfilePageSegmenter), ("profile_line", "line_segmenter", ProfileLineSegmenter), ("components", "line_segmenter", ComponentSegmenter),
    ("perceptron", "classifier", PerceptronClassifier), ("boosted", "classifier", BoostedClassifier),
):
    register(_name, _interface, _constructor)
