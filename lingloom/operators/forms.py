"""Unicode normalization forms; Spark has no function for them, so they run in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions.languages import Language
from .base import Stage, ValidationError, is_ascii


@dataclass(frozen=True)
class UnicodeForm(Stage):
    form: str

    def __post_init__(self) -> None:
        if self.form not in ("NFC", "NFD", "NFKC", "NFKD"):
            raise ValidationError(self.form, "is no normalization form")

    @property
    def name(self) -> str:  # type: ignore[override]
        return self.form.lower()

    @property
    def fusable(self) -> bool:
        return False

    def gate(self, lang: Language) -> Callable[[Column], Column]:
        return lambda col: ~is_ascii(col)

    def python(self, lang: Language) -> Callable[[str], str]:
        form = self.form
        return lambda text: text if text.isascii() else unicodedata.normalize(form, text)


NFC, NFD, NFKC, NFKD = map(UnicodeForm, ("NFC", "NFD", "NFKC", "NFKD"))
