"""The 34 languages: what each changes when lowering, folding, transliterating, removing diacritics and segmenting."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from enum import Enum


class SegmentRule(Enum):
    WESTERN_TO_SCRIPT = "WesternToScript"
    SCRIPT_TO_WESTERN = "ScriptToWestern"
    CJK_IDEOGRAPH_UNIGRAM = "CJKIdeographUnigram"


@dataclass(frozen=True)
class Language:
    """A language's tables. Flags are derived from the tables, so an override can't contradict them."""

    code: str
    name: str
    case_map: dict[str, str] = field(default_factory=dict)
    fold_map: dict[str, str] = field(default_factory=dict)
    transliterate_map: dict[str, str] = field(default_factory=dict)
    precomposed_to_base: dict[str, str] = field(default_factory=dict)
    spacing_diacritics: str = ""
    segment_rules: tuple[SegmentRule, ...] = ()
    unigram_cjk: bool = False

    def __hash__(self) -> int:
        return hash((self.code, self.name))

    @property
    def needs_segmentation(self) -> bool:
        return bool(self.segment_rules)

    @property
    def has_one_to_one_folds(self) -> bool:
        return all(len(v) == 1 for v in self.fold_map.values())

    @property
    def has_one_to_one_transliterate(self) -> bool:
        return all(len(v) == 1 for v in self.transliterate_map.values())

    def is_spacing_diacritic(self, char: str) -> bool:
        return char in self.spacing_diacritics

    def is_transliterable(self, char: str) -> bool:
        return char in self.transliterate_map

    def is_precomposed(self, char: str) -> bool:
        return char in self.precomposed_to_base

    def lowercase(self, char: str) -> str:
        """The language's own mapping, else the first character of Unicode's; never depends on context."""
        return self.case_map.get(char) or char.lower()[:1]

    def case_fold(self, char: str) -> str:
        return self.fold_map.get(char) or self.lowercase(char)

    def modified(self, change: Callable[[Language], Language] | None = None, **tables: object) -> Language:
        """A changed copy of this language; the registered one stays as it is."""
        changed = replace(self, **tables)
        return change(changed) if change else changed

    def with_segment_rules(self, *rules: SegmentRule) -> Language:
        """Rules decide whether single ideographs are segmented."""
        return replace(self, segment_rules=rules, unigram_cjk=SegmentRule.CJK_IDEOGRAPH_UNIGRAM in rules)


def _bases(letters: str, **other: str) -> dict[str, str]:
    """Each letter to the letter it is composed from."""
    return {c: unicodedata.normalize("NFD", c)[0] for c in letters} | other


def _pairs(spec: str) -> dict[str, str]:
    return dict(p.split(":") for p in spec.split())


def _vietnamese() -> dict[str, str]:
    """Every vowel, plain or with breve, circumflex or horn, under each of the six tones, and the barred d."""
    shapes = {"a": "̆̂", "o": "̛̂", "e": "̂", "u": "̛", "i": "", "y": ""}
    lower = {unicodedata.normalize("NFC", v + s + t): v for v, marks in shapes.items() for s in ("", *marks) for t in ("", "̀", "́", "̉", "̃", "̣")}
    lower["đ"] = "d"
    return lower | {c.upper(): b.upper() for c, b in lower.items()}


def _russian() -> dict[str, str]:
    lower = _pairs("а:a б:b в:v г:g д:d е:e ё:ë ж:ž з:z и:i й:j к:k л:l м:m н:n о:o п:p р:r с:s т:t у:u ф:f х:h ц:c ч:č ш:š щ:šč ъ:ʺ ы:y ь:ʹ э:è ю:ju я:ja")
    return lower | {c.upper(): t[0].upper() + t[1:] for c, t in lower.items()}


def _marks(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


_SCRIPT = (SegmentRule.WESTERN_TO_SCRIPT, SegmentRule.SCRIPT_TO_WESTERN)

# Names and tables by language, in the order in which the languages are listed.
_ALL = (
    Language("TUR", "Turkish", case_map=_pairs("İ:i I:ı")),
    Language("DEU", "German", fold_map=_pairs("ß:ss ẞ:ss"), transliterate_map=_pairs("Ä:ae ä:ae Ö:oe ö:oe Ü:ue ü:ue")),
    Language("NLD", "Dutch", fold_map=_pairs("Ĳ:ij ĳ:ij")),
    Language("DAN", "Danish", transliterate_map=_pairs("Å:aa å:aa Æ:ae æ:ae Ø:oe ø:oe")),
    Language("NOR", "Norwegian", transliterate_map=_pairs("Æ:ae æ:ae Ø:oe ø:oe Å:aa å:aa")),
    Language("SWE", "Swedish", transliterate_map=_pairs("Å:aa å:aa Ä:ae ä:ae Ö:oe ö:oe")),
    Language("ISL", "Icelandic", transliterate_map=_pairs("Þ:th þ:th Ð:d ð:d Æ:ae æ:ae")),
    Language("ARA", "Arabic", spacing_diacritics=_marks((0x64B, 0x650), (0x652, 0x658), (0x670, 0x670))),
    Language("HEB", "Hebrew", spacing_diacritics=_marks((0x5B0, 0x5BD), (0x5BF, 0x5BF), (0x5C1, 0x5C2), (0x5C4, 0x5C5), (0x5C7, 0x5C7))),
    Language("VIE", "Vietnamese", precomposed_to_base=_vietnamese(), spacing_diacritics="̣̀́̃̉"),
    Language("FRA", "French", transliterate_map=_pairs("Œ:oe œ:oe Æ:ae æ:ae Ç:c ç:c"), precomposed_to_base=_bases("ÀàÂâÈèÉéÊêËëÎîÏïÔôÙùÛûÜüŸÿ")),
    Language("CES", "Czech", precomposed_to_base=_bases("ČčĎďĚěŇňŘřŠšŤťŽžŮů")),
    Language("SLK", "Slovak", precomposed_to_base=_bases("ČčĎďĽľŇňŠšŤťŽžĹĺŔŕÔô")),
    Language("POL", "Polish", precomposed_to_base=_bases("ąĄęĘóÓżŻźŹśŚćĆńŃ", ł="l", Ł="L")),
    Language("CAT", "Catalan", transliterate_map=_pairs("Ç:c ç:c"), precomposed_to_base=_bases("ÀàÁáÈèÉéÍíÏïÚúÜü")),
    Language("SPA", "Spanish", precomposed_to_base=_bases("ÁáÉéÍíÓóÚúÜü")),
    Language("POR", "Portuguese", precomposed_to_base=_bases("ÀàÁáÂâÃãÇçÉéÊêÍíÓóÔôÕõÚúÜü")),
    Language("ITA", "Italian", precomposed_to_base=_bases("ÀàÈèÉéÌìÒòÙù")),
    Language("HRV", "Croatian", precomposed_to_base=_bases("ČčĆćŠšŽž") | _pairs("Đ:D đ:d ǈ:L ǉ:l ǋ:N ǌ:n")),
    Language("SRP", "Serbian", precomposed_to_base=_pairs("Ђ:D ђ:d Ј:J ј:j Љ:L љ:l Њ:N њ:n Ћ:C ћ:c Џ:D џ:d Ž:Z ž:z")),
    Language("LIT", "Lithuanian", case_map=_pairs("Ė:ė Į:į Ų:ų")),
    Language("ELL", "Greek", spacing_diacritics="́̈͂̓̔ͅ"),
    Language("HIN", "Hindi", spacing_diacritics="़ँंः्", segment_rules=_SCRIPT),
    Language("BEN", "Bengali", spacing_diacritics="়ঁংঃ্", segment_rules=_SCRIPT),
    Language("TAM", "Tamil", spacing_diacritics="்", segment_rules=_SCRIPT),
    Language("RUS", "Russian", transliterate_map=_russian()),
    Language("JPN", "Japanese", segment_rules=_SCRIPT),
    Language("ZHO", "Chinese (Simplified)", segment_rules=(SegmentRule.WESTERN_TO_SCRIPT, SegmentRule.CJK_IDEOGRAPH_UNIGRAM, SegmentRule.SCRIPT_TO_WESTERN)),
    Language("KOR", "Korean", segment_rules=_SCRIPT),
    Language("THA", "Thai", spacing_diacritics=_marks((0xE31, 0xE31), (0xE34, 0xE3A), (0xE47, 0xE4E)), segment_rules=_SCRIPT),
    Language("LAO", "Lao", spacing_diacritics=_marks((0xEB1, 0xEB1), (0xEB4, 0xEB9), (0xEBB, 0xEBC), (0xEC8, 0xECD)), segment_rules=_SCRIPT),
    Language("MYA", "Myanmar", spacing_diacritics=_marks((0x102B, 0x1032), (0x1036, 0x103E)), segment_rules=_SCRIPT),
    Language("KHM", "Khmer", spacing_diacritics=_marks((0x17B6, 0x17D3), (0x17DD, 0x17DD)), segment_rules=_SCRIPT),
    Language("ENG", "English"),
)
#: Short codes accepted besides the three-letter ones.
_ALIASES = _pairs("tr:TUR de:DEU nl:NLD da:DAN no:NOR sv:SWE is:ISL ar:ARA he:HEB vi:VIE fr:FRA cs:CES sk:SLK pl:POL ca:CAT es:SPA pt:POR it:ITA hr:HRV sr:SRP lt:LIT el:ELL hi:HIN bn:BEN ta:TAM ru:RUS ja:JPN zh:ZHO ko:KOR th:THA lo:LAO my:MYA km:KHM en:ENG")
# End of fixed values.

_BY_CODE = {x.code: x for x in _ALL}
DEFAULT = "ENG"


def all_languages() -> tuple[Language, ...]:
    return _ALL


def find(code: str) -> Language | None:
    """By three-letter code in any case, or two-letter code; None if unknown."""
    return _BY_CODE.get(code.upper()) or _BY_CODE.get(_ALIASES.get(code.lower(), ""))


def language(code: str | Language) -> Language:
    found = code if isinstance(code, Language) else find(code)
    if found is None:
        raise ValueError(f"unknown language: {code!r}")
    return found


def codes() -> Iterable[str]:
    return _BY_CODE
