"""White space: trimming, collapsing of runs, and Unicode's spaces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.languages import Language
from .base import Stage, ValidationError, is_ascii

UNICODE = r"\p{IsWhite_Space}"
ASCII = r"[ \t\n\f\r]"
#: Fails at visible ASCII characters before any class is tried.
QUICK = "(?![!-~])"
#: In text that is all ASCII, the vertical tab counts in either mode.
ASCII_ONLY = r"[ \t\n\x0B\f\r]"


@dataclass(frozen=True)
class NormalizeWhitespace(Stage):
    """``trim`` drops the runs at both ends. ``collapse`` turns a run of two or more into one ``replacement``; a single
    space stays as it is, unless it is none of ASCII's and ``normalize_unicode`` is on. ``normalize_unicode`` alone only
    decides what counts as space, so without the others nothing changes."""

    collapse: bool = True
    trim: bool = True
    normalize_unicode: bool = True
    replacement: str = " "
    name = "normalize_whitespace"

    def __post_init__(self) -> None:
        if len(self.replacement) != 1:
            raise ValidationError(self.name, f"the replacement is one character, not {self.replacement!r}")

    def replace_whitespace_with(self, char: str) -> NormalizeWhitespace:
        return replace(self, replacement=char)

    def with_normalize_unicode(self) -> NormalizeWhitespace:
        return replace(self, normalize_unicode=True)

    def _form(self, col: Column, space: str, single: str) -> Column:
        if self.trim:
            col = F.regexp_replace(col, rf"{QUICK}(?:\A{space}+|{space}+\z)", "")
        if self.collapse:
            quoted = "\\" + self.replacement if self.replacement in "\\$" else self.replacement
            col = F.regexp_replace(col, f"{QUICK}(?:{space}{{2,}}{single})", quoted)
        return col

    def gate(self, lang: Language) -> Callable[[Column], Column]:
        # Ends, runs, and single spaces of other kinds.
        return lambda col: col.rlike(rf"{QUICK}(?:\A{UNICODE}|{UNICODE}\z|{UNICODE}{{2}}|[{UNICODE}&&[^ \t\n\f\r]])")

    def apply(self, col: Column, lang: Language) -> Column:
        if not (self.collapse or self.trim):
            return col
        foreign = rf"|[{UNICODE}&&[^ \t\n\f\r]]" if self.normalize_unicode else ""
        return F.when(is_ascii(col), self._form(col, ASCII_ONLY, "")).otherwise(self._form(col, UNICODE if self.normalize_unicode else ASCII, foreign))


NORMALIZE_WHITESPACE_FULL = NormalizeWhitespace()
COLLAPSE_WHITESPACE = NormalizeWhitespace(trim=False, normalize_unicode=False)
COLLAPSE_WHITESPACE_UNICODE = NormalizeWhitespace(trim=False)
TRIM_WHITESPACE = NormalizeWhitespace(collapse=False, normalize_unicode=False)
TRIM_WHITESPACE_UNICODE = NormalizeWhitespace(collapse=False)
