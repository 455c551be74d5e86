"""Slow, plain models of the stages, character by character, to hold the columns against."""

from __future__ import annotations

import unicodedata

from lingloom.functions import charsets
from lingloom.functions.languages import Language, SegmentRule

SPACES = set(charsets.WHITE_CHARS)


def lowercase(text: str, lang: Language) -> str:
    return "".join(lang.lowercase(c) for c in text)


def case_fold(text: str, lang: Language) -> str:
    return "".join(lang.case_fold(c) for c in text)


def transliterate(text: str, lang: Language) -> str:
    return "".join(lang.transliterate_map.get(c, c) for c in text)


def remove_diacritics(text: str, lang: Language) -> str:
    return "".join(lang.precomposed_to_base.get(c, "" if c in lang.spacing_diacritics else c) for c in text)


def normalize_punctuation(text: str, lang: Language) -> str:
    return "".join(next((p for p, cs in charsets.PUNCTUATION.items() if c in cs), c) for c in text)


def unify_width(text: str, lang: Language) -> str:
    return "".join(" " if c == "　" else chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in text)


def remove_control_chars(text: str, lang: Language) -> str:
    return "".join(c for c in text if unicodedata.category(c) != "Cc")


def remove_format_controls(text: str, lang: Language) -> str:
    return "".join(c for c in text if not charsets.contains(charsets.FORMAT_CONTROL, c))


def whitespace(text: str, collapse: bool, trim: bool, normalize_unicode: bool, replacement: str) -> str:
    if text.isascii():
        is_space = set(" \t\n\x0b\x0c\r").__contains__
    elif normalize_unicode:
        is_space = SPACES.__contains__
    else:
        is_space = set(" \t\n\x0c\r").__contains__
    if trim:
        while text and is_space(text[0]):
            text = text[1:]
        while text and is_space(text[-1]):
            text = text[:-1]
    if not collapse:
        return text
    out, run = [], ""
    for c in [*text, None]:
        if c is not None and is_space(c):
            run += c
            continue
        if len(run) == 1:
            foreign = normalize_unicode and not text.isascii() and run not in " \t\n\x0c\r"
            out.append(replacement if foreign else run)
        elif run:
            out.append(replacement)
        run = ""
        out.append(c or "")
    return "".join(out)


def segment(text: str, lang: Language) -> str:
    if not lang.segment_rules:
        return text
    out: list[str] = []
    before = ""
    for c in text:
        if c in SPACES or c == "​":
            before = ""
        elif c not in "‌‍":
            if before:
                a, b = charsets.char_class(before), charsets.char_class(c)
                if a == b == "Indic" and before in charsets.VIRAMAS and c not in charsets.VIRAMAS:
                    if not (lang.code == "HIN" and c in charsets.JOINED):
                        out.append("​")
                elif a == b == "Cjk" and lang.unigram_cjk:
                    out.append(" ")
                elif a != b and (a != "Western" or SegmentRule.WESTERN_TO_SCRIPT in lang.segment_rules) and (b != "Western" or SegmentRule.SCRIPT_TO_WESTERN in lang.segment_rules):
                    out.append(" ")
            before = c
        out.append(c)
    return "".join(out)
