"""Markdown to text: CommonMark blocks and inlines, with strikethrough, tables, task lists, footnotes and math.

Blocks are set apart by one line end, cells of a table by a space. Links and images leave their text, code its content;
raw HTML stays, and so does math with its dollars. Text without any sign of Markdown is returned as it is.
"""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions.charsets import WHITE_CHARS
from ..functions.languages import Language
from .base import Stage

#: Signs that are Markdown wherever they stand, and list markers and rules at a line's start.
SIGNS = re.compile(r"[#*_`~>|]|(?:\A|\n)(?:[-+] |---(?:[\n \t\r]|\Z)|[0-9]+\. )")

RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*\Z")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^\n]*)\Z")
QUOTE = re.compile(r" {0,3}> ?")
QUOTES = re.compile(r"(?: {0,3}> ?)+")
ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])([ \t]+|\Z)")
UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*\Z")
DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]*(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?=\n|\Z)")
NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
TASK = re.compile(r"\[([ xX])\][ \t]+(?=\S)")

ATTRIBUTE = r"""[ \t\n]+[A-Za-z_:][\w.:-]*(?:[ \t\n]*=[ \t\n]*(?:[^ \t\n"'=<>`]+|'[^']*'|"[^"]*"))?"""
OPEN_TAG, CLOSE_TAG = rf"<[A-Za-z][A-Za-z0-9-]*(?:{ATTRIBUTE})*[ \t\n]*/?>", r"</[A-Za-z][A-Za-z0-9-]*[ \t\n]*>"
INLINE_HTML = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>", re.ASCII)
ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|(\w+));", re.ASCII)
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
TARGET = re.compile(r"""\([ \t\n]*(?:<(?:[^<>\n\\]|\\.)*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))*)(?:[ \t\n]+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t\n]*\)""", re.S)
MATH = re.compile(r"\$\$.+?\$\$|\$(?![\s$])(?:[^$\\]|\\.)*?(?<![\s\\])\$(?!\w)", re.S)
Inner = tuple[list[str], bool]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# How blocks of HTML begin and end, by kind; the last two end at a blank line.
HTML_BLOCKS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|\Z)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(
        r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html"
        r"|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|\Z)", re.I), None),
    (re.compile(rf" {{0,3}}(?:{OPEN_TAG}|{CLOSE_TAG})[ \t]*\Z"), None),
)
# End of fixed values.


def marked(text: str) -> bool:
    """Whether there is any sign of Markdown."""
    return bool(SIGNS.search(text)) or ("[" in text and "]" in text and "(" in text)


class _Out:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.last = ""

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.last = text[-1]

    def begin(self) -> None:
        if self.last and self.last != "\n":
            self.put("\n")

    def end(self) -> None:
        if self.last != "\n":
            self.put("\n")


def _label(text: str) -> str:
    return " ".join(text.casefold().split())


class _Document:
    def __init__(self, text: str) -> None:
        self.out = _Out()
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.references: set[str] = set()
        self.notes: set[str] = {_label(m[1]) for line in lines if (m := NOTE.match(line))}
        for line in lines:
            if (m := DEFINITION.match(re.sub(r"^(?: {0,3}> ?)+", "", line))) and not m[1].startswith("^"):
                self.references.add(_label(m[1]))
        # Blocks within blocks wait on a stack of their own, so depth is bounded by memory only.
        open_ = [self.blocks([line.replace("\t", "    ") if line[: len(line) - len(line.lstrip())].count("\t") else line for line in lines])]
        while open_:
            if inner := next(open_[-1], None):
                open_.append(self.blocks(*inner))
            else:
                open_.pop()

    # Blocks. Those that hold others yield (lines, whether it is a list's item) to have them read before they go on.

    def blocks(self, lines: list[str], item: bool = False) -> Iterator[Inner]:
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
            elif line.startswith("    "):
                i = self.indented(lines, i)
            elif (m := FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
                i = self.fenced(lines, i, m)
            elif m := HEADING.match(line):
                self.leaf(m[1] or "")
                i += 1
            elif self.is_rule(line):
                self.out.put("\n")
                i += 1
            elif QUOTE.match(line):
                i = yield from self.quote(lines, i)
            elif m := ITEM.match(line):
                i = yield from self.list_(lines, i, m)
            elif (kind := self.html_kind(line)) is not None:
                i = self.html(lines, i, kind)
            elif m := NOTE.match(line):
                i = yield from self.note(lines, i, m)
            elif self.is_table(lines, i):
                i = self.table(lines, i)
            else:
                i = self.paragraph(lines, i, item and i == 0)

    def leaf(self, text: str) -> None:
        self.out.begin()
        self.out.put(self.inline(text))
        self.out.end()

    def indented(self, lines: list[str], i: int) -> int:
        j = i
        while j < len(lines) and (lines[j].startswith("    ") or not lines[j].strip()):
            j += 1
        own = lines[i:j]
        while not own[-1].strip():
            own.pop()
        self.code([x[4:] for x in own])
        return i + len(own)

    def code(self, lines: list[str]) -> None:
        self.out.begin()
        for x in lines:
            self.out.put(x + "\n")
        self.out.end()

    def fenced(self, lines: list[str], i: int, m: re.Match[str]) -> int:
        indent, fence = len(m[1]), m[2]
        close = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*\Z")
        j = i + 1
        while j < len(lines) and not close.match(lines[j]):
            j += 1
        own = lines[i + 1 : j]
        if j == len(lines) and own and not own[-1]:
            own.pop()
        self.code([x[min(indent, len(x) - len(x.lstrip(" "))) :] for x in own])
        return j + 1

    def quote(self, lines: list[str], i: int) -> Generator[Inner, None, int]:
        own: list[str] = []
        while i < len(lines):
            line = lines[i]
            if m := QUOTE.match(line):
                own.append(line[m.end() :])
            elif own and own[-1].strip() and line.strip() and not self.interrupts(lines, i) and not FENCE.match(own[-1]):
                own.append(line.lstrip())  # a lazy continuation
            else:
                break
            i += 1
        # Quotes directly within quotes say nothing of their own: the levels that all lines have go at once.
        if deeper := min(m[0].count(">") if (m := QUOTES.match(line)) else 0 for line in own):
            inner = re.compile(rf"(?: {{0,3}}> ?){{{deeper}}}")
            own = [line[inner.match(line).end() :] for line in own]
        self.out.begin()
        yield own, False
        self.out.end()
        return i

    @staticmethod
    def is_rule(line: str) -> bool:
        return line.rstrip()[-1:] in ("-", "*", "_") and bool(RULE.match(line))

    def list_(self, lines: list[str], i: int, first: re.Match[str]) -> Generator[Inner, None, int]:
        kind = first[2][-1]
        self.out.begin()
        while i < len(lines) and (m := ITEM.match(lines[i])) and m[2][-1] == kind and not self.is_rule(lines[i]):
            gap = len(m[3]) if m[3] and len(m[3]) <= 4 else 1
            width = len(m[1]) + len(m[2]) + gap
            own = [lines[i][min(width, len(lines[i])) :]]
            i += 1
            while i < len(lines):
                line = lines[i]
                if not line.strip():
                    k = i
                    while k < len(lines) and not lines[k].strip():
                        k += 1
                    if k == len(lines) or len(lines[k]) - len(lines[k].lstrip(" ")) < width:
                        break
                    own += [""] * (k - i)
                    i = k
                elif len(line) - len(line.lstrip(" ")) >= width:
                    own.append(line[width:])
                    i += 1
                elif own[-1].strip() and not ITEM.match(line) and not self.interrupts(lines, i):
                    own.append(line.lstrip())
                    i += 1
                else:
                    break
            self.out.begin()
            yield own, True
            self.out.end()
            k = i
            while k < len(lines) and not lines[k].strip():
                k += 1
            if k < len(lines) and (m := ITEM.match(lines[k])) and m[2][-1] == kind:
                i = k
        self.out.end()
        return i

    @staticmethod
    def html_kind(line: str) -> int | None:
        return next((k for k, (begin, _) in enumerate(HTML_BLOCKS) if begin.match(line)), None) if "<" in line else None

    def html(self, lines: list[str], i: int, kind: int) -> int:
        end = HTML_BLOCKS[kind][1]
        while i < len(lines):
            if end is None and not lines[i].strip():
                break
            self.out.put(lines[i] + "\n")
            i += 1
            if end is not None and end.search(lines[i - 1]):
                break
        return i

    def note(self, lines: list[str], i: int, m: re.Match[str]) -> Generator[Inner, None, int]:
        own = [lines[i][m.end() :]]
        i += 1
        while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip() or (own[-1].strip() and not self.interrupts(lines, i) and not NOTE.match(lines[i]))):
            own.append(lines[i][4:] if lines[i].startswith("    ") else lines[i])
            i += 1
        yield own, False
        return i

    @staticmethod
    def cells(line: str) -> list[str]:
        line = line.strip()
        line = line[1:] if line.startswith("|") else line
        if line.endswith("|") and not line.endswith("\\|"):
            line = line[:-1]
        return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]

    def is_table(self, lines: list[str], i: int) -> bool:
        return i + 1 < len(lines) and "|" in lines[i] and bool(DELIMITERS.match(lines[i + 1])) and len(self.cells(lines[i])) == len(self.cells(lines[i + 1]))

    def table(self, lines: list[str], i: int) -> int:
        width = len(self.cells(lines[i]))
        self.out.begin()
        self.row(self.cells(lines[i]))
        i += 2
        while i < len(lines) and lines[i].strip() and not self.interrupts(lines, i):
            self.out.begin()
            self.row((self.cells(lines[i]) + [""] * width)[:width])
            i += 1
        self.out.end()
        return i

    def row(self, cells: list[str]) -> None:
        for k, cell in enumerate(cells):
            self.out.put(self.inline(cell))
            if k + 1 < len(cells) and (not self.out.last or self.out.last not in WHITE_CHARS):
                self.out.put(" ")
        self.out.end()

    def interrupts(self, lines: list[str], i: int) -> bool:
        """Whether a line ends a paragraph before it."""
        line = lines[i]
        m = ITEM.match(line)
        item = m and m[3] and line[m.end() :].strip() and (not m[2][0].isdigit() or m[2][:-1].lstrip("0") == "1")
        fence = (f := FENCE.match(line)) and not (f[2][0] == "`" and "`" in f[3])
        html_ = (kind := self.html_kind(line)) is not None and kind < 6
        return bool(fence or HEADING.match(line) or self.is_rule(line) or QUOTE.match(line) or item or html_)

    def paragraph(self, lines: list[str], i: int, task: bool) -> int:
        own = [lines[i].lstrip(" \t")]
        i += 1
        heading = False
        while i < len(lines) and lines[i].strip():
            if UNDERLINE.match(lines[i]):
                heading = True
                i += 1
                break
            if self.interrupts(lines, i):
                break
            own.append(lines[i].lstrip(" \t"))
            i += 1
        text = "\n".join(own)
        while m := DEFINITION.match(text):
            if m[1].startswith("^"):
                break
            self.references.add(_label(m[1]))
            text = text[m.end() :].lstrip("\n")
        if not text.strip():
            return i - heading if heading and not text else i
        if task and (m := TASK.match(text)):
            self.out.put("[ ] " if m[1] == " " else "[x] ")
            self.out.put(self.inline(text[m.end() :].rstrip()))
            self.out.end()
        else:
            self.leaf(text.rstrip())
        return i

    # Inlines

    def inline(self, text: str) -> str:
        nodes: list[_Node] = []
        brackets: list[tuple[int, bool, bool]] = []  # node, image, active
        at, n = 0, len(text)
        plain = re.compile(r"[^\\`<&!\[\]*_~$\n]+")
        put = lambda s: nodes.append(_Node(s))
        while at < n:
            if m := plain.match(text, at):
                put(m[0])
                at = m.end()
                continue
            c = text[at]
            if c == "\\" and at + 1 < n and (text[at + 1] in PUNCTUATION or text[at + 1] == "\n"):
                put(text[at + 1])
                at += 2
            elif c == "`":
                run = re.compile(r"`+").match(text, at)[0]
                close = re.compile(rf"(?<!`){run}(?!`)").search(text, at + len(run))
                if close:
                    code = text[at + len(run) : close.start()].replace("\n", " ")
                    put(code[1:-1] if code.strip(" ") and code[0] == code[-1] == " " and len(code) > 1 else code)
                    at = close.end()
                else:
                    put(run)
                    at += len(run)
            elif c == "<" and (m := AUTOLINK.match(text, at)):
                put(m[1])
                at = m.end()
            elif c == "<" and (m := INLINE_HTML.match(text, at)) or c == "$" and (m := MATH.match(text, at)):
                put(m[0])
                at = m.end()
            elif c == "&" and (m := ENTITY.match(text, at)):
                put(_entity(m))
                at = m.end()
            elif c == "\n":
                if nodes:
                    nodes[-1].text = nodes[-1].text.rstrip(" ") if not nodes[-1].count else nodes[-1].text
                put("\n")
                at += 1
            elif c == "[" and (m := re.compile(r"\[\^([^\]\s]+)\]").match(text, at)) and _label(m[1]) in self.notes:
                put(m[1])
                at = m.end()
            elif c == "[" or c == "!" and text.startswith("[", at + 1):
                size = 1 + (c == "!")
                brackets.append((len(nodes), c == "!", True))
                put(text[at : at + size])
                at += size
            elif c == "]":
                at = self.closes(text, at, nodes, brackets)
            elif c in "*_~":
                run = re.compile(re.escape(c) + "+").match(text, at)[0]
                nodes.append(_run(text, at, run))
                at += len(run)
            else:
                put(c)
                at += 1
        _emphasis(nodes, 0)
        return "".join(x.text for x in nodes)

    def closes(self, text: str, at: int, nodes: list[_Node], brackets: list[tuple[int, bool, bool]]) -> int:
        """A closing bracket: the text of a link or an image if a target follows or a reference is known."""
        if not brackets:
            nodes.append(_Node("]"))
            return at + 1
        node, image, active = brackets.pop()
        end = None
        if active:
            if m := TARGET.match(text, at + 1):
                end = m.end()
            else:
                inner = text[self.opened(text, at) : at]
                m = LABEL.match(text, at + 1)
                if m and _label(m[1] or inner) in self.references:
                    end = m.end()
                elif _label(inner) in self.references and not (m and m[1]):
                    end = at + 1
        if end is None:
            nodes.append(_Node("]"))
            return at + 1
        nodes[node].text = ""
        _emphasis(nodes, node)
        if not image:
            brackets[:] = [(i, img, on and img) for i, img, on in brackets]
        return end

    @staticmethod
    def opened(text: str, at: int) -> int:
        """Start of the bracketed text that ends at ``at``."""
        depth = 0
        for i in range(at - 1, -1, -1):
            if text[i] == "]" and (not i or text[i - 1] != "\\"):
                depth += 1
            elif text[i] == "[" and (not i or text[i - 1] != "\\"):
                if not depth:
                    return i + 1
                depth -= 1
        return 0


@dataclass
class _Node:
    """Text, or a run of ``count`` delimiters that may open or close."""

    text: str
    count: int = 0
    opens: bool = False
    closes: bool = False
    size: int = 0


def _entity(m: re.Match[str]) -> str:
    decimal, hexadecimal, name = m.groups()
    if name:
        return html.entities.html5.get(name + ";", m[0])
    code = int(decimal) if decimal else int(hexadecimal, 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _run(text: str, at: int, run: str) -> _Node:
    before, after = text[at - 1] if at else "\n", text[at + len(run)] if at + len(run) < len(text) else "\n"
    sign = lambda c: c in PUNCTUATION or unicodedata.category(c)[0] in "PS"
    left = not after.isspace() and (not sign(after) or before.isspace() or sign(before))
    right = not before.isspace() and (not sign(before) or after.isspace() or sign(after))
    if run[0] == "_":
        opens, closes = left and (not right or sign(before)), right and (not left or sign(after))
    else:
        opens, closes = left, right
    if run[0] == "~" and len(run) > 2:
        opens = closes = False
    return _Node(run, len(run), opens, closes, len(run))


def _emphasis(nodes: list[_Node], bottom: int) -> None:
    """Takes matched delimiters out of the nodes from ``bottom`` on; what is left of a run is text."""
    openers: list[_Node] = []
    for node in nodes[bottom:]:
        if not node.count:
            continue
        sign = node.text[0]
        while node.closes and node.count:
            k = len(openers) - 1
            while k >= 0:
                o = openers[k]
                if o.count and o.text[0] == sign:
                    if sign == "~":
                        if o.count == node.count:
                            break
                    elif not ((o.closes or node.opens) and (o.size + node.size) % 3 == 0 and (o.size % 3 or node.size % 3)):
                        break
                k -= 1
            if k < 0:
                break
            o = openers[k]
            use = node.count if sign == "~" else 2 if o.count >= 2 and node.count >= 2 else 1
            for x in (o, node):
                x.count -= use
                x.text = sign * x.count
            del openers[k + 1 :]
            if not o.count:
                openers.pop()
        if node.opens and node.count:
            openers.append(node)
    for node in nodes[bottom:]:
        node.count = 0


def strip(text: str) -> str:
    if not text or not marked(text):
        return text
    document = _Document(text)
    return "".join(document.out.parts).strip(WHITE_CHARS)


@dataclass(frozen=True)
class StripMarkdown(Stage):
    name = "strip_markdown"

    @property
    def fusable(self) -> bool:
        return False

    def gate(self, lang: Language) -> Callable[[Column], Column]:
        return lambda col: col.rlike(SIGNS.pattern.replace(r"\Z", r"\z")) | col.contains("[") & col.contains("]") & col.contains("(")

    def python(self, lang: Language) -> Callable[[str], str]:
        return strip
