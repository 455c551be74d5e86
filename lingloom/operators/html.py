"""HTML to text: entities first, then markup away."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions.charsets import WHITE_CHARS
from ..functions.languages import Language
from .base import Stage

# Elements whose content goes with them, and elements that are set apart by a space. Element names are read
# up to their first character that is no letter, so headings with a digit are not among the latter.
DROPPED = frozenset("script style noscript svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form header hgroup hr li main nav ol p pre section table ul tr td th thead tbody tfoot title head body".split()
)
# End of fixed values.

ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|(\w+));", re.ASCII)
NAME = re.compile(r"[A-Za-z]*")
#: The rest of a tag; quoted values may hold a closing bracket, and a backslash there hides a quote.
REST = re.compile(r"""(?:[^"'>]|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')*+>""", re.S)


def _entity(m: re.Match[str]) -> str:
    decimal, hexadecimal, name = m.groups()
    if name:
        return html.entities.html5.get(name + ";", m[0])
    code = int(decimal) if decimal else int(hexadecimal, 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def decode(text: str) -> str:
    """Entities that end in a semicolon; unknown ones stay."""
    return ENTITY.sub(_entity, text) if "&" in text else text


def strip(text: str) -> str:
    text = decode(text)
    if "<" not in text:
        return text
    out: list[str] = []
    last, at, n = "", 0, len(text)

    def put(part: str) -> None:
        nonlocal last
        if part:
            out.append(part)
            last = part[-1]

    def apart(name: str) -> None:
        if name.lower() in BLOCKS and last and last not in WHITE_CHARS:
            put(" ")

    def after(end: int, size: int) -> int:
        return n if end < 0 else end + size

    def tag(start: int) -> int:
        m = REST.match(text, start)
        return m.end() if m else n

    while at < n:
        begin = text.find("<", at)
        if begin < 0:
            put(text[at:])
            break
        put(text[at:begin])
        inner = begin + 1
        if text.startswith("!--", inner):
            at = after(text.find("-->", inner + 3), 3)
        elif text.startswith("![", inner) and text[inner + 2 : inner + 8].lower() == "cdata[":
            end = text.find("]]>", inner + 8)
            put(text[inner + 8 : end] if end >= 0 else text[inner + 8 :])
            at = after(end, 3)
        elif text.startswith("?", inner):
            at = after(text.find("?>", inner + 1), 2)
        elif text.startswith("/", inner):
            apart(NAME.match(text, inner + 1)[0])
            at = tag(inner)
        else:
            name = NAME.match(text, inner)[0]
            if name.lower() in DROPPED:
                opened = after(text.find(">", inner + len(name)), 1)
                closing = re.compile(rf"</{name}(?=[> \t\n\r]|\Z)", re.I).search(text, opened)
                at = tag(closing.end()) if closing else n
            else:
                apart(name)
                at = tag(inner)
    return "".join(out).strip(WHITE_CHARS)


@dataclass(frozen=True)
class StripHtml(Stage):
    """Tags, comments, declarations and processing instructions away, CDATA kept, entities decoded, both ends trimmed if
    there was any markup."""

    name = "strip_html"

    @property
    def fusable(self) -> bool:
        return False

    def gate(self, lang: Language) -> Callable[[Column], Column]:
        return lambda col: col.contains("<") | col.contains("&")

    def python(self, lang: Language) -> Callable[[str], str]:
        return strip
