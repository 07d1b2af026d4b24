"""Lazy pipelines: a plan from an evaluation window to a DataFrame, with row order as metadata.

Window filters live at the sources (and where an operator moves time); summaries stamped at the window's
stop survive everything downstream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from meridia.span import Span

TIME = "time"


@dataclass(frozen=True)
class Pipeline:
    """``plan(span)`` gives rows with a ``time`` column; ``order`` breaks ties of time, ascending unless ``-name``."""

    plan: Callable[[Span], DataFrame]
    order: tuple[str, ...] = ()
    acausal: bool = False

    def __or__(self, operator: Callable[[Pipeline], Pipeline]) -> Pipeline:
        return operator(self)

    def load(self, span: Span) -> DataFrame:
        return self.plan(span)

    def then(self, step: Callable[[DataFrame, Span], DataFrame], **changes: Any) -> Pipeline:
        return replace(self, plan=lambda span: step(self.plan(span), span), **changes)

    def window(self, key: tuple[str, ...] = ()) -> WindowSpec:
        return Window.partitionBy(*[F.col(k) for k in key] or [F.lit(0)]).orderBy(*self.sort())

    def running(self, key: tuple[str, ...] = ()) -> WindowSpec:
        return self.window(key).rowsBetween(Window.unboundedPreceding, 0)

    def sort(self, descending: bool = False) -> list:
        cols = [F.col(TIME).desc() if descending else F.col(TIME).asc()]
        for name in self.order:
            down = name.startswith("-") != descending
            cols.append(F.col(name.lstrip("-")).desc() if down else F.col(name.lstrip("-")).asc())
        return cols

    def rank(self) -> Any:
        """A struct that orders rows as the pipeline does (ascending order columns only)."""
        if any(o.startswith("-") for o in self.order):
            raise ValueError("descending ties can't be ranked inside an aggregate; give an ascending order column")
        return F.struct(TIME, *self.order)


def like(plan: Callable[[Span], DataFrame], p: Pipeline) -> Callable[[Span], DataFrame]:
    """``plan``, marked as ``p``'s is: for wrappers that change no row."""
    if hasattr(p.plan, "every"):
        plan.every = p.plan.every
    return plan


def names(value: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    return () if value is None else (value,) if isinstance(value, str) else tuple(value)


def fresh(df: DataFrame, *columns: str) -> None:
    """Refuse output names that are taken."""
    taken = [c for c in columns if c in df.columns]
    if taken:
        raise ValueError(f"columns exist already: {', '.join(taken)}")
