"""Word segmentation by script: borders between classes of characters, single ideographs, broken conjuncts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import charsets
from ..functions.charsets import SCRIPTS, java
from ..functions.languages import Language, SegmentRule
from .base import Stage

#: Joiners are looked through.
JOINERS = "\u200c\u200d"
LOOK = f"[{java(JOINERS)}]*+"
SKIP = java(charsets.WHITE_SPACE, "\u200b" + JOINERS)


#: Two characters of plain text, between which there is never a border.
PLAIN = r"[ -~\n]"
FOREIGN = f"(?!{PLAIN})[^{java(SCRIPTS['Western'])}{SKIP}]"


def _inside(unigram: bool) -> str:
    """Fails fast inside a run of one class, before any class is tried: plain text, or each script's largest block."""
    blocks = [max((r for r in ranges if r[1] < 0x10000), key=lambda r: r[1] - r[0]) for name, ranges in SCRIPTS.items() if name != "Western" and not (unigram and name == "Cjk")]
    return f"(?!{PLAIN}{{2}}|{'|'.join(f'[{java((r,))}]{{2}}' for r in blocks)})"


@dataclass(frozen=True)
class SegmentWords(Stage):
    """Inserts a space where the class of characters changes, as the language's rules allow, and a zero-width space
    after a virama. Space and zero-width space start afresh. Languages without rules stay as they are."""

    name = "segment_words"

    def gate(self, lang: Language) -> Callable[[Column], Column]:
        # A text all Western has no border.
        return lambda col: col.rlike(FOREIGN)

    def apply(self, col: Column, lang: Language) -> Column:
        if not lang.segment_rules:
            return col
        kept = charsets.JOINED if lang.code == "HIN" else ""
        indic = java(charsets.INDIC)
        some = java(((ord(min(charsets.VIRAMAS)), ord(max(charsets.VIRAMAS))),))
        # A match takes the character before a border, so that the next one may start right after it.
        broken = f"(?=[{some}])([{java(charsets.VIRAMAS)}&&[{indic}]]{LOOK})(?=[{indic}&&[^{java(charsets.VIRAMAS + kept)}]])"
        into, out = SegmentRule.WESTERN_TO_SCRIPT in lang.segment_rules, SegmentRule.SCRIPT_TO_WESTERN in lang.segment_rules
        western = java(SCRIPTS["Western"])
        known = java(*SCRIPTS.values())
        borders = [f"[{western}]{LOOK}(?=[^{western}{SKIP}])"] if into else []
        for name, ranges in SCRIPTS.items():
            if name != "Western":
                own = java(ranges)
                after = f"[^{own}{SKIP}{'' if out else western}]"
                alone = f"|[{own}]" if name == "Cjk" and lang.unigram_cjk else ""
                borders.append(f"[{own}]{LOOK}(?={after}{alone})")
        # Half of a surrogate pair is no character of its own.
        scripts = known if out else java(*[r for n, r in SCRIPTS.items() if n != "Western"])
        borders.append(f"[^{known}{SKIP}\\x{{d800}}-\\x{{dfff}}]{LOOK}(?=[{scripts}])")
        done = F.regexp_replace(F.regexp_replace(col, broken, "$1\u200b"), f"{_inside(lang.unigram_cjk)}((?:{'|'.join(borders)}))", "$1 ")
        return F.when(col.rlike(FOREIGN), done).otherwise(col)
