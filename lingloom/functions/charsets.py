"""Sets of code points, as Java and Python regular-expression classes.

Ranges are inclusive. They are given as numbers, not as Unicode script names, so that every library that reads them
agrees whatever its Unicode version.
"""

from __future__ import annotations

from collections.abc import Iterable

Ranges = tuple[tuple[int, int], ...]

# The code points that each operator and class is about.
CONTROL: Ranges = ((0x00, 0x1F), (0x7F, 0x9F))
FORMAT_CONTROL: Ranges = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0x206A, 0x206F), (0xFEFF, 0xFEFF))
ASCII_SPACE = " \t\n\x0c\r"
#: Unicode's White_Space property.
WHITE_SPACE: Ranges = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
PUNCTUATION = {'"': "“”„«»′″", "'": "‘’‚", "-": "–—─―", ".": "…⋯․‧", "*": "•·∙", "<": "‹", ">": "›"}
CJK: Ranges = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF),
    (0x30000, 0x3134F), (0x31350, 0x323AF), (0xF900, 0xFAFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF), (0x1B000, 0x1B16F), (0x2F00, 0x2FDF),
)
HANGUL: Ranges = ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xD7B0, 0xD7FF))
SE_ASIAN: Ranges = ((0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0xAA60, 0xAA7F), (0xA9E0, 0xA9FF), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x1A00, 0x1AAF))
INDIC: Ranges = ((0x0900, 0x0DFF), (0xA8E0, 0xA8FF), (0x11FC0, 0x11FFF))
WESTERN: Ranges = ((0x21, 0x7E), (0xC0, 0x2AF))
ALPHABETIC: Ranges = ((0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0700, 0x074F), (0x0750, 0x077F), (0x0870, 0x089F), (0x08A0, 0x08FF), (0x10A0, 0x10FF), (0x13A0, 0x13FF))
VIRAMAS = "्্੍્୍்్್്්်្᮪᭄"
#: Hindi consonants that stay joined to a virama: ra, ya, va, ha.
JOINED = "रयवह"
EMOJI: Ranges = ((0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x2600, 0x26FF), (0x2700, 0x27BF), (0xFE0E, 0xFE0F))
BERT_HAN: Ranges = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
# End of fixed values.

#: Classes in the order in which a character is tried against them; what is in none is Other.
SCRIPTS: dict[str, Ranges] = {"Cjk": CJK, "Hangul": HANGUL, "SEAsian": SE_ASIAN, "Indic": INDIC, "Western": WESTERN, "NonCJKScript": ALPHABETIC}


def members(ranges: Ranges) -> Iterable[int]:
    return (c for a, b in ranges for c in range(a, b + 1))


def contains(ranges: Ranges, char: str) -> bool:
    return any(a <= ord(char) <= b for a, b in ranges)


def java(*ranges: Ranges | str) -> str:
    """The inside of a Java character class."""
    parts = [(ord(c), ord(c)) for r in ranges if isinstance(r, str) for c in r] + [x for r in ranges if not isinstance(r, str) for x in r]
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in parts)


WHITE_CHARS = "".join(map(chr, members(WHITE_SPACE)))


def char_class(char: str) -> str:
    """Whitespace, Western, Cjk, Hangul, SEAsian, Indic, NonCJKScript or Other."""
    if char in WHITE_CHARS and char != "\x0b":
        return "Whitespace"
    return next((name for name, ranges in SCRIPTS.items() if contains(ranges, char)), "Other")
