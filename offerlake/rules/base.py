"""What a supplier rule set is, and the registry in order of detection.

A rule set is data plus column expressions. ``custom`` is the way out for layouts
that no expression covers: a function of the document texts to item rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

@dataclass(frozen=True)
class RuleSet:
    """Rules of one supplier.

    detect: predicate over the normalised, lower-cased text.
    is_start: (line, following line) to true where a position begins.
    shape: blocks (see ``operators.items.blocks``) to raw item columns.
    prepare: rewrite of the text before it is cut into lines.
    per_page: positions never run over a page end.
    carry: the head of a page belongs to the position before it, as ``carried`` beside its block; without it, page heads are blocks.
    headings: shape reads the text before a block.
    filled_only: the layout is read without blank lines.
    count: number of positions in a text, where it is not the number of item rows.
    refine: (header columns, normalised text) to better header columns.
    after: pass over all items of a document.
    custom: document texts to item rows, instead of is_start and shape.
    notes: normalised text to the notes of a document.
    delivery: (document texts, item rows) to further item rows.
    pricing: how positions come to their prices: by the "chain" of printed conditions, by the "line", by printed discount "groups".
    room_labels: the code of a position leads its long text.
    """

    key: str
    supplier_name: str
    detect: Callable[[Column], Column]
    is_start: Callable[[Column, Column], Column] | None = None
    shape: Callable[[DataFrame], DataFrame] | None = None
    prepare: Callable[[Column], Column] | None = None
    per_page: bool = False
    carry: bool = False
    headings: bool = False
    filled_only: bool = False
    count: Callable[[Column], Column] | None = None
    refine: Callable[[dict[str, Column], Column], dict[str, Column]] | None = None
    notes: Callable[[Column], Column] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None
    custom: Callable[[DataFrame], DataFrame] | None = None
    delivery: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    pricing: str = "chain"
    room_labels: bool = False


@dataclass
class Registry:
    """Ordered: the first rule set whose predicate holds is the document's."""

    rules: list[RuleSet] = field(default_factory=list)

    def add(self, rule: RuleSet, before: str | None = None) -> None:
        if any(r.key == rule.key for r in self.rules):
            raise ValueError(f"rule set {rule.key} exists")
        at = len(self.rules) if before is None else [r.key for r in self.rules].index(before)
        self.rules.insert(at, rule)

    def keys(self, **having: object) -> list[str]:
        """Keys of the rule sets whose fields have these values."""
        return [r.key for r in self.rules if all(getattr(r, name) == value for name, value in having.items())]

    def get(self, key: str) -> RuleSet:
        return next(r for r in self.rules if r.key == key)
