"""Plug-in points: anything with these shapes can take part in a plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame


class Component(Protocol):
    """Adds feature columns to bars."""

    names: tuple[str, ...]

    def __call__(self, frame: DataFrame) -> DataFrame: ...


class Labeller(Protocol):
    def __call__(self, frame: DataFrame) -> DataFrame: ...


class Splitter(Protocol):
    def __call__(self, frame: DataFrame) -> DataFrame: ...


class Guard(Protocol):
    """Raises ValueError on a fault."""

    def __call__(self, frame: DataFrame, names: tuple[str, ...]) -> None: ...


@dataclass(frozen=True)
class ModelSpec:
    """A named model recipe: ``score`` makes a prediction column, ``fit`` (if any) makes it from training rows."""

    name: str
    family: str
    score: Callable[[], Column] | None = None
    fit: Callable[[DataFrame], Callable[[], Column]] | None = None
    history_hours: int | None = None
