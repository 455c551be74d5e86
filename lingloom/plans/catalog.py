"""Queries of the operators over the test tables, with the same results in SQL.

The texts hold few of the characters that some operators are about, so queries derive inputs from them, the same way in
Spark and in SQL: ``translate`` to full width, spaces and controls put in, words replaced by other scripts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets
from ..functions.languages import Language, SegmentRule, all_languages, language
from ..operators.html import BLOCKS, DROPPED
from ..operators.whitespace import NormalizeWhitespace
from ..sources.tables import languages, read
from .pipeline import Pipeline, by_language
from .presets import BERT_MARKS, PRESETS, preset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def lit(text: str) -> str:
    """A SQL literal; characters other than printable ASCII by number."""
    parts, plain = [], ""
    for c in text:
        if " " <= c <= "~":
            plain += "''" if c == "'" else c
        else:
            parts += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
    parts += [f"'{plain}'"] * bool(plain or not parts)
    return "(" + " || ".join(parts) + ")"


def table_sql(expression: str, table: dict[str, str]) -> str:
    """A character table in SQL: long images first, then one translation."""
    for c, image in table.items():
        if len(image) > 1:
            expression = f"replace({expression}, {lit(c)}, {lit(image)})"
    one = {c: i for c, i in table.items() if len(i) == 1 and c != i}
    gone = "".join(c for c, i in table.items() if not i)
    return f"translate({expression}, {lit(''.join(one) + gone)}, {lit(''.join(one.values()))})" if one or gone else expression


def _documents(name: str, pipeline: Pipeline, derive: Callable[[Column], Column] | None = None, sql: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.col("text") if derive is None else derive(F.col("text"))
        return pipeline.transform(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text", "normalized").select("doc_id", "normalized")

    QUERIES[name] = query
    if sql is not None:
        SQL[name] = f"SELECT doc_id, {sql} AS normalized FROM documents"


def _case_sql(lang: Language, expression: str = "text", fold: bool = False) -> str:
    # SQL's lower case is Unicode's by character, so a language's own letters go first.
    own = lang.case_map | (lang.fold_map if fold else {})
    return f"lower({table_sql(expression, own)})"


def _one(stage: str, code: str = "ENG") -> Pipeline:
    return Pipeline.from_names([stage], code)


def _capitals(col: Column) -> Column:
    """Words in turn give way to words with capitals of other scripts."""
    return F.replace(F.replace(F.replace(col, F.lit("e"), F.lit("İI")), F.lit("o"), F.lit("ΣẞÉ")), F.lit("a"), F.lit("ЖĲ"))


CAPITALS = f"replace(replace(replace(text, 'e', {lit('İI')}), 'o', {lit('ΣẞÉ')}), 'a', {lit('ЖĲ')})"

for _code in ("ENG", "TUR", "LIT"):
    _documents(f"lowercase_{_code.lower()}", _one("lowercase", _code), _capitals, _case_sql(language(_code), CAPITALS))
for _code in ("DEU", "NLD", "TUR"):
    _documents(f"casefold_{_code.lower()}", _one("case_fold", _code), _capitals, _case_sql(language(_code), CAPITALS, True))

for _code in ("DEU", "DAN", "NOR", "SWE", "ISL", "FRA", "CAT", "RUS"):
    _own = language(_code).transliterate_map
    # Frequent letters give way to the language's own ones.
    _from, _to = "etaoinsrhldcumETAOINSRHLDCUM"[: len(_own)], "".join(_own)[:28]
    _documents(f"transliterate_{_code.lower()}", _one("transliterate", _code), lambda c, a=_from, b=_to: F.translate(c, a, b), table_sql(f"translate(text, {lit(_from)}, {lit(_to)})", _own))

for _code in ("FRA", "CES", "SLK", "POL", "CAT", "SPA", "POR", "ITA", "HRV", "SRP", "VIE", "ARA", "HEB", "ELL", "HIN", "BEN", "TAM", "THA", "LAO", "MYA", "KHM"):
    _lang = language(_code)
    _chars = "".join(c for c in _lang.precomposed_to_base if not c.isascii())[:40] + _lang.spacing_diacritics
    _from = "etaoinsrhldcumfpgwybvkxqjzETAOINSRHLDCUMFPGWYBVKXQJZ"[: len(_chars)]
    _to = _chars[: len(_from)]
    _documents(f"diacritics_{_code.lower()}", _one("remove_diacritics", _code), lambda c, a=_from, b=_to: F.translate(c, a, b), table_sql(f"translate(text, {lit(_from)}, {lit(_to)})", dict.fromkeys(_lang.spacing_diacritics, "") | _lang.precomposed_to_base))

_signs = {c: plain for plain, chars in charsets.PUNCTUATION.items() for c in chars}
_documents("punctuation", _one("normalize_punctuation"), lambda c: F.translate(c, "etaoinsrhldcumfpgwybv", "".join(_signs)), table_sql(f"translate(text, 'etaoinsrhldcumfpgwybv', {lit(''.join(_signs))})", _signs))
_wide = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {"　": " "}
_documents("width", _one("unify_width"), lambda c: F.translate(c, "".join(_wide.values()), "".join(_wide)), table_sql(f"translate(text, {lit(''.join(_wide.values()))}, {lit(''.join(_wide))})", _wide))
_controls = "".join(chr(c) for c in charsets.members(charsets.CONTROL) if c)
_from = "etaoinsrhldcumfpgwybvkxqjzETAOINSRHLDCUMFPGWYBVKXQJZ0123456789.,"
_documents("control_chars", _one("remove_control_chars"), lambda c: F.translate(c, _from, _controls[: len(_from)]), table_sql(f"translate(text, {lit(_from)}, {lit(_controls[: len(_from)])})", dict.fromkeys(_controls, "")))
_formats = "".join(map(chr, charsets.members(charsets.FORMAT_CONTROL)))
_documents("format_controls", _one("remove_format_controls"), lambda c: F.translate(c, _from[: len(_formats)], _formats), table_sql(f"translate(text, {lit(_from[: len(_formats)])}, {lit(_formats)})", dict.fromkeys(_formats, "")))

# White space: spaces become runs, of ASCII's and of Unicode's kinds, with some at both ends.
SPACED = f"replace(replace(replace({lit('  ')} || text || {lit(chr(9) + chr(0xA0))}, '. ', {lit('.' + chr(0xA0) * 2)}), 'e ', {lit('e ' + chr(9))}), 'd ', {lit('d' + chr(0x3000))})"


def _spaced(c: Column) -> Column:
    c = F.concat(F.lit("  "), c, F.lit("\t\xa0"))
    return F.replace(F.replace(F.replace(c, F.lit(". "), F.lit(".\xa0\xa0")), F.lit("e "), F.lit("e \t")), F.lit("d "), F.lit("d　"))


_any = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_foreign = r"[\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_plain = r"[ \t\n\f\r]"


def _space_sql(w: NormalizeWhitespace, sql: str = SPACED) -> str:
    space = _any if w.normalize_unicode else _plain
    if w.trim:
        sql = rf"regexp_replace({sql}, '\A{space}+|{space}+\z', '', 'g')"
    if w.collapse:
        sql = f"regexp_replace({sql}, '{space}{{2,}}{'|' + _foreign if w.normalize_unicode else ''}', {lit(w.replacement)}, 'g')"
    return sql


for _name in ("normalize_whitespace_full", "collapse_whitespace", "collapse_whitespace_unicode", "trim_whitespace", "trim_whitespace_unicode"):
    _p = _one(_name)
    _documents(_name, _p, _spaced, _space_sql(_p.stages[0]))
_dash = NormalizeWhitespace().replace_whitespace_with("_")
_documents("whitespace_replaced", Pipeline((_dash,)), _spaced, _space_sql(_dash))
_late = NormalizeWhitespace(normalize_unicode=False).with_normalize_unicode()
_documents("whitespace_with_unicode", Pipeline((_late,)), _spaced, _space_sql(_late))

# Segmentation: some syllables become characters of other scripts.
_SCRIPTS = {"th": "世界", "er": "の", "on": "서울", "an": "สวัสดี", "re": "क्ष", "qu": "Ж"}


def _scripted(c: Column) -> Column:
    for a, b in _SCRIPTS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _scripted_sql() -> str:
    sql = "text"
    for a, b in _SCRIPTS.items():
        sql = f"replace({sql}, '{a}', {lit(b)})"
    return sql


def _re2(ranges: charsets.Ranges) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def _segment_sql(lang: Language) -> str:
    """RE2 can't look around: each border is matched with its two characters, twice, as matches don't overlap.

    The derived texts hold no joiners, so these needn't be looked through."""
    sql = _scripted_sql()
    indic, viramas = _re2(charsets.INDIC), "".join(rf"\x{{{ord(c):x}}}" for c in charsets.VIRAMAS)
    kept = r"\x{930}\x{92f}\x{935}\x{939}" if lang.code == "HIN" else ""
    spaces = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{200b}"
    sql = rf"regexp_replace({sql}, '([\x{{94d}}])([\x{{904}}-\x{{939}}])', '\1' || chr(8203) || '\2', 'g')" if not kept else rf"regexp_replace({sql}, '([\x{{94d}}])([\x{{904}}-\x{{92e}}\x{{931}}-\x{{934}}\x{{936}}-\x{{938}}])', '\1' || chr(8203) || '\2', 'g')"
    every = "".join(_re2(r) for r in charsets.SCRIPTS.values())
    for own in [*map(_re2, charsets.SCRIPTS.values())]:
        for _ in range(2):
            sql = rf"regexp_replace({sql}, '([{own}])([^{own}{spaces}])', '\1 \2', 'g')"
    for _ in range(2):
        sql = rf"regexp_replace({sql}, '([^{every}{spaces}])([{every}])', '\1 \2', 'g')"
    if lang.unigram_cjk:
        cjk = _re2(charsets.CJK)
        for _ in range(2):
            sql = rf"regexp_replace({sql}, '([{cjk}])([{cjk}])', '\1 \2', 'g')"
    return sql


_single = language("ZHO").with_segment_rules(*SegmentRule)
for _name, _lang in {"segment_zho": language("ZHO"), "segment_jpn": language("JPN"), "segment_kor": language("KOR"), "segment_tha": language("THA"), "segment_hin": language("HIN"), "segment_ben": language("BEN"), "segment_zho_unigram": _single}.items():
    _documents(_name, Pipeline.from_names(["segment_words"], _lang), _scripted, _segment_sql(_lang))
_documents("segment_eng", _one("segment_words"), _scripted, _scripted_sql())

# Forms: composed and decomposed letters, ligatures and wide letters.
_documents("nfc", _one("nfc"), lambda c: F.replace(F.replace(c, F.lit("e"), F.lit("é")), F.lit("o"), F.lit("ộ")), f"nfc_normalize(replace(replace(text, 'e', {lit('é')}), 'o', {lit('ộ')}))")


def _decomposed(form: str) -> dict[str, str]:
    """Full decompositions of the letters and signs that the texts, as they are or derived, can hold."""
    blocks = [(0xA0, 0x17F), (0x2018, 0x2026), (0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0x3000, 0x3000)]
    return {chr(c): d for a, b in blocks for c in range(a, b + 1) if (d := unicodedata.normalize(form, chr(c))) != chr(c)}


def _form_sql(form: str, expression: str) -> str:
    if form == "nfkc":
        return f"nfc_normalize({_form_sql('nfkd', expression)})"
    return table_sql(expression, _decomposed(form.upper()))


_wide_sql = f"replace(replace(text, 'fi', {lit('ﬁ')}), 'A', {lit('Ａ')})"
for _form in ("nfd", "nfkc", "nfkd"):
    _documents(_form, _one(_form), lambda c: F.replace(F.replace(c, F.lit("fi"), F.lit("ﬁ")), F.lit("A"), F.lit("Ａ")), _form_sql(_form, _wide_sql))
_documents("nfkc_ascii", _one("nfkc"), lambda c: F.translate(c, "".join(_wide.values())[:-1], "".join(_wide)[:-1]), "text")


def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one("strip_html").transform(read(spark, sf_dir, "pages").select("page_id", "html"), "html", "normalized").select("page_id", "normalized")


def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents and over conversations' turns."""
    pipeline = _one("strip_markdown")
    docs = read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), pipeline.col("text").alias("normalized"))
    turns = read(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", pipeline.col("text").alias("normalized"))
    return docs.unionAll(turns)


def per_row_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row under the language that its column names."""
    pipeline = Pipeline.from_names(["case_fold", "transliterate"])
    return read(spark, sf_dir, "documents").select("doc_id", "lang", by_language(pipeline, "text", "lang", ("de", "fr", "es")).alias("normalized"))


def needs_apply_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a pipeline would change, by language."""
    pipeline = Pipeline.from_names(["lowercase", "remove_diacritics"], "FRA")
    docs = read(spark, sf_dir, "documents").select("lang", pipeline.needs_apply("text").cast("int").alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_changed"))


def normalized_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal once normalized; only a hash of the text is shuffled."""
    pipeline = Pipeline.from_names(["case_fold", "normalize_punctuation", "normalize_whitespace_full"])
    keyed = read(spark, sf_dir, "documents").select("doc_id", F.sha2(pipeline.col("text"), 256).alias("text_hash"))
    return keyed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def custom_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of one's own among registered ones: emoji away, Han characters padded."""
    pipeline = Pipeline.from_names(["strip_emoji", "bert_compat_chinese_chars", "lowercase"])
    text = F.replace(F.replace(F.col("text"), F.lit("th"), F.lit("世")), F.lit("er"), F.lit("\U0001f600✂️"))
    return read(spark, sf_dir, "documents").select("doc_id", pipeline.col(text).alias("normalized"))


def languages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = languages(spark)
    sizes = {"n_case": "case_map", "n_fold": "fold_map", "n_transliterate": "transliterate_map", "n_precomposed": "precomposed_to_base_map", "n_spacing": "spacing_diacritics", "n_rules": "segment_rules"}
    return table.select("code", "name", *[F.size(c).alias(n) for n, c in sizes.items()], "needs_segmentation", "unigram_cjk")


def needs_apply_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each stage alone would change."""
    names = ("lowercase", "remove_diacritics", "normalize_punctuation", "normalize_whitespace_full", "strip_html", "nfc")
    pipelines = {n: _one(n, "FRA") for n in names}
    flags = read(spark, sf_dir, "documents").select(*[p.needs_apply("text").cast("int").alias(n) for n, p in pipelines.items()])
    return flags.agg(*[F.sum(n).alias(n) for n in names])


def needs_apply_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that hold Markdown, by role."""
    turns = read(spark, sf_dir, "conversations").select("role", _one("strip_markdown").needs_apply("text").cast("int").alias("n"))
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n").alias("n_changed"))


for _query in (strip_html, strip_markdown, per_row_lang, needs_apply_rate, normalized_dedup, custom_stage, languages_table, needs_apply_by_stage, needs_apply_markdown):
    QUERIES[_query.__name__] = _query


def _html_sql(expression: str) -> str:
    """Markup away, for texts without CDATA and without a closing bracket in an attribute.

    Entities first, the ampersand last; what is dropped whole and tags that set nothing apart, in one scan; then the other
    tags as marks, which give a space behind a character that is none."""
    sql = expression
    for name, char in {"lt": "<", "gt": ">", "quot": '"', "copy": "©", "middot": "·", "nbsp": "\xa0", "amp": "&"}.items():
        sql = f"replace({sql}, '&{name};', {lit(char)})"
    dropped = "|".join(rf"<{n}(?:[^a-z>][^>]*)?>.*?(?:</{n}(?:[ \t\n\r][^>]*)?>|\z)" for n in sorted(DROPPED))
    blocks = rf"</?(?:{'|'.join(sorted(BLOCKS))})(?:[^a-z>][^>]*)?(?:>|\z)"
    mark, space = lit("\x01"), _any
    marked = f"regexp_replace(regexp_replace(decoded, '(?is)<!--.*?(?:-->|\\z)|{dropped}|({blocks})|<[^>]*(?:>|\\z)', '\\1', 'g'), '(?s)<[^>]*(?:>|\\z)', {mark}, 'g')"
    spaced = rf"regexp_replace(regexp_replace({marked}, '(\A|{space})\x01+', '\1', 'g'), '\x01+', ' ', 'g')"
    stripped = rf"regexp_replace({spaced}, '\A{space}+|{space}+\z', '', 'g')"
    return f"(SELECT CASE WHEN contains(decoded, '<') THEN {stripped} ELSE decoded END FROM (SELECT {sql} AS decoded))"


SQL["strip_html"] = f"SELECT page_id, {_html_sql('html')} AS normalized FROM pages"
_own = {"lowercase": "lower(text)", "remove_diacritics": table_sql("text", dict.fromkeys(language("FRA").spacing_diacritics, "") | language("FRA").precomposed_to_base), "normalize_punctuation": table_sql("text", _signs), "normalize_whitespace_full": _space_sql(NormalizeWhitespace(), "text"), "strip_html": _html_sql("text"), "nfc": "nfc_normalize(text)"}
SQL["needs_apply_by_stage"] = "SELECT " + ", ".join(f"sum((text <> {e})::INT)::BIGINT AS {n}" for n, e in _own.items()) + " FROM documents"

_de, _fr, _es = (f"lower({table_sql('text', language(c).fold_map)})" for c in ("DEU", "FRA", "SPA"))
SQL["per_row_lang"] = f"""SELECT doc_id, lang, CASE lang WHEN 'de' THEN {table_sql(_de, language("DEU").transliterate_map)}
  WHEN 'fr' THEN {table_sql(_fr, language("FRA").transliterate_map)} WHEN 'es' THEN {_es} ELSE lower(text) END AS normalized FROM documents"""
_changed = f"(lower(text) <> text OR {table_sql('text', language('FRA').precomposed_to_base)} <> text)"
SQL["needs_apply_rate"] = f"SELECT lang, count(*) AS n_docs, sum({_changed}::INT)::BIGINT AS n_changed FROM documents GROUP BY lang"
SQL["normalized_dedup"] = rf"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace({table_sql("lower(text)", _signs)}, '\A{_any}+|{_any}+\z', '', 'g'), '{_any}{{2,}}|{_foreign}', ' ', 'g') AS t FROM documents)
SELECT sha256(t) AS text_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM n GROUP BY 1 HAVING count(*) > 1"""
SQL["custom_stage"] = f"SELECT doc_id, lower(replace(replace(text, 'th', {lit(' 世 ')}), 'er', '')) AS normalized FROM documents"
SQL["languages_table"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{x.code}', '{x.name}', {len(x.case_map)}, {len(x.fold_map)}, {len(x.transliterate_map)}, {len(x.precomposed_to_base)}, {len(x.spacing_diacritics)}, {len(x.segment_rules)}, {str(x.needs_segmentation).lower()}, {str(x.unigram_cjk).lower()})" for x in all_languages()
) + ") AS t(code, name, n_case, n_fold, n_transliterate, n_precomposed, n_spacing, n_rules, needs_segmentation, unigram_cjk)"


#: Stages of the presets in SQL, for French.
_STAGES: dict[str, Callable[[str], str]] = {
    "nfkc": lambda e: _form_sql("nfkc", e), "nfd": lambda e: _form_sql("nfd", e), "strip_html": _html_sql, "lowercase": lambda e: f"lower({e})", "segment_words": lambda e: e,
    "remove_control_chars": lambda e: table_sql(e, dict.fromkeys(_controls, "")), "remove_format_controls": lambda e: table_sql(e, dict.fromkeys(_formats, "")),
    "normalize_punctuation": lambda e: table_sql(e, _signs), "unify_width": lambda e: table_sql(e, _wide),
    "normalize_whitespace_full": lambda e: _space_sql(NormalizeWhitespace(), e), "collapse_whitespace_unicode": lambda e: _space_sql(NormalizeWhitespace(trim=False), e),
    "bert_compat_chinese_chars": lambda e: rf"regexp_replace({e}, '([{_re2(charsets.BERT_HAN)}])', ' \1 ', 'g')", "remove_diacritics": lambda e: table_sql(e, dict.fromkeys(BERT_MARKS, "")),
}


def _preset(name: str) -> None:
    pipeline = preset(name, "FRA") if name in PRESETS else preset(name)
    names = [s.name for s in pipeline.stages] if name == "bert_like" else PRESETS[name]
    sql: str | None = "text"
    for n in ["collapse_whitespace_unicode" if n == "normalize_whitespace" else n for n in names]:
        # Diacritics go with the marks of decomposed text alone, as in the BERT-like preset.
        known = n in _STAGES and (n != "remove_diacritics" or name == "bert_like")
        sql = _STAGES[n](sql) if known and sql is not None else None
    _documents(f"preset_{name}", pipeline, None, sql)


for _name in [*PRESETS, "bert_like"]:
    _preset(_name)


def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four character stages composed into one table, then white space: the flagship."""
    pipeline = Pipeline.from_names(["lowercase", "remove_diacritics", "normalize_punctuation", "unify_width", "normalize_whitespace_full"], "FRA")
    return pipeline.transform(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "normalized").select("doc_id", "normalized")


QUERIES["fused_search"] = fused_search
SQL["fused_search"] = rf"""SELECT doc_id, regexp_replace(regexp_replace({table_sql(table_sql(table_sql("lower(text)", language("FRA").precomposed_to_base), _signs), _wide)}, '\A{_any}+|{_any}+\z', '', 'g'), '{_any}{{2,}}|{_foreign}', ' ', 'g') AS normalized FROM documents"""
