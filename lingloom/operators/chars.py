"""Stages that map one character at a time: case, transliteration, diacritics, punctuation, width, controls."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column

from ..functions import charsets
from ..functions.languages import Language
from .base import Stage


@lru_cache(1)
def _lower() -> dict[str, str]:
    """Every character whose lower case starts with another character. No context, no second character."""
    return {c: low for c in map(chr, range(sys.maxunicode + 1)) if (low := c.lower()[:1]) != c and low}


@dataclass(frozen=True)
class LowerCase(Stage):
    """The language's case map, else Unicode's lower case, first character only (so no final sigma, no dot above)."""

    name = "lowercase"

    def mapping(self, lang: Language) -> dict[str, str]:
        return _lower() | lang.case_map


@dataclass(frozen=True)
class CaseFold(Stage):
    """The language's folds (one to many), else as LowerCase."""

    name = "case_fold"

    def mapping(self, lang: Language) -> dict[str, str]:
        return _lower() | lang.case_map | lang.fold_map


@dataclass(frozen=True)
class Transliterate(Stage):
    """The language's own letters in others; what is foreign to the language stays."""

    name = "transliterate"

    def mapping(self, lang: Language) -> dict[str, str]:
        return dict(lang.transliterate_map)


@dataclass(frozen=True)
class RemoveDiacritics(Stage):
    """Composed letters to their base, then the language's separate marks away. A composed letter goes before a mark."""

    name = "remove_diacritics"

    def mapping(self, lang: Language) -> dict[str, str]:
        return dict.fromkeys(lang.spacing_diacritics, "") | lang.precomposed_to_base


@dataclass(frozen=True)
class NormalizePunctuation(Stage):
    """Typographic quotes, dashes, dots, bullets and angles in ASCII."""

    name = "normalize_punctuation"

    def mapping(self, lang: Language) -> dict[str, str]:
        return {c: plain for plain, chars in charsets.PUNCTUATION.items() for c in chars}


@dataclass(frozen=True)
class UnifyWidth(Stage):
    """Full-width forms of ASCII, and the ideographic space, in ASCII."""

    name = "unify_width"

    def mapping(self, lang: Language) -> dict[str, str]:
        shift = 0xFEE0
        return {chr(c + shift): chr(c) for c in range(0x21, 0x7F)} | {"　": " "}


@dataclass(frozen=True)
class StripControlChars(Stage):
    """Control characters away, tabs and line ends among them."""

    name = "remove_control_chars"

    def mapping(self, lang: Language) -> dict[str, str]:
        return {chr(c): "" for c in charsets.members(charsets.CONTROL)}


@dataclass(frozen=True)
class StripFormatControls(Stage):
    """Zero-width and directional characters away."""

    name = "remove_format_controls"

    def mapping(self, lang: Language) -> dict[str, str]:
        return {chr(c): "" for c in charsets.members(charsets.FORMAT_CONTROL)}


@dataclass(frozen=True)
class StripEmoji(Stage):
    """Emoji and their presentation selectors away: an example of a stage of one's own."""

    name = "strip_emoji"

    def mapping(self, lang: Language) -> dict[str, str]:
        return {chr(c): "" for c in charsets.members(charsets.EMOJI)}


@dataclass(frozen=True)
class PadHan(Stage):
    """A space on each side of every Han character, as BERT's basic tokenizer wants it."""

    name = "bert_compat_chinese_chars"

    def apply(self, col: Column, lang: Language) -> Column:
        from pyspark.sql import functions as F

        first = min(a for a, _ in charsets.BERT_HAN)  # below it one look is enough
        return F.regexp_replace(col, f"(?![\\x00-\\x{{{first - 1:x}}}])([{charsets.java(charsets.BERT_HAN)}])", " $1 ")
