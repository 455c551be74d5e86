"""What a stage is: a named function from a text column to a text column, under a language.

Null text stays null in every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.languages import Language


class StageError(Exception):
    """A stage can't be built or applied."""

    def __init__(self, stage: str, message: str) -> None:
        super().__init__(f"stage {stage!r}: {message}")
        self.stage, self.message = stage, message


class ValidationError(StageError):
    """A stage's parameters make no sense."""


@dataclass(frozen=True)
class Stage:
    """Base of all stages. A stage gives one of three forms; the pipeline composes adjacent stages of one form.

    ``mapping``: a table from characters to strings, for stages that look at one character at a time;
    ``python``: a function of one text, for those that Spark's own functions can't express;
    ``apply``: a column expression, for the rest.
    """

    name = "stage"

    def mapping(self, lang: Language) -> dict[str, str] | None:
        return None

    def python(self, lang: Language) -> Callable[[str], str] | None:
        return None

    def apply(self, col: Column, lang: Language) -> Column:
        raise StageError(self.name, "has no form")

    def gate(self, lang: Language) -> Callable[[Column], Column] | None:
        """A cheap look at a text, false only where the stage changes nothing; none if there is no such look."""
        if (table := self.mapping(lang)) is None:
            return None
        quick = "".join(c for c in table if c.isascii() and table[c] != c)
        if not quick:
            return lambda col: ~is_ascii(col)
        return lambda col: ~is_ascii(col) | col.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in quick) + "]")

    def column(self, col: Column, lang: Language, gated: bool = True) -> Column:
        """The stage alone. ``gated`` names ``col`` more than once, which is for columns, not for long expressions."""
        from ..plans.compose import emit, in_python

        if (table := self.mapping(lang)) is not None:
            return emit(col, table)
        if (function := self.python(lang)) is not None:
            return in_python(col, [function], [self.gate(lang)] if gated else [])
        return self.apply(col, lang)

    def needs_apply(self, col: Column, lang: Language) -> Column:
        """Whether the stage would change the text. Where the gate says no, the stage isn't run."""
        gate = self.gate(lang)
        changed = ~self.column(col, lang).eqNullSafe(col)
        return changed if gate is None else F.when(gate(col), changed).otherwise(False)

    @property
    def fusable(self) -> bool:
        """Whether it composes with neighbours into one table of characters or runs as a plain expression."""
        return True


@dataclass(frozen=True)
class ColumnStage(Stage):
    """A stage of one's own, from a function of a column."""

    function: Callable[[Column], Column]
    label: str = "custom"

    @property
    def name(self) -> str:  # type: ignore[override]
        return self.label

    def apply(self, col: Column, lang: Language) -> Column:
        return self.function(col)


@dataclass(frozen=True)
class TextStage(Stage):
    """A stage of one's own, from a function of a text; runs in Arrow batches."""

    function: Callable[[str], str]
    label: str = "custom"

    @property
    def name(self) -> str:  # type: ignore[override]
        return self.label

    @property
    def fusable(self) -> bool:
        return False

    def python(self, lang: Language) -> Callable[[str], str]:
        return self.function


def is_ascii(col: Column) -> Column:
    return F.length(col) == F.octet_length(col)
