"""Golden pairs and properties of the stages."""

from __future__ import annotations

import random
import unicodedata

import pytest

from lingloom.functions import charsets
from lingloom.functions.languages import SegmentRule, all_languages, find, language
from lingloom.operators import html, markdown
from lingloom.operators.base import ColumnStage, TextStage, ValidationError
from lingloom.operators.whitespace import NormalizeWhitespace
from lingloom.plans.pipeline import REGISTRY, Pipeline, by_language, register
from lingloom.plans.presets import PRESETS, preset

from . import oracle


def run(spark, pipeline: Pipeline, texts: list[str | None], fuse: bool = True) -> list[str | None]:
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["t"] for r in frame.select("i", pipeline.col("text", fuse).alias("t")).orderBy("i").collect()]


# Expected results by stage and language.
GOLDEN = [
    ("lowercase", "TUR", {"İ": "i", "I": "ı", "İSTANBUL": "istanbul", "ISPARTA": "ısparta"}),
    ("lowercase", "DEU", {"ẞ": "ß", "GROẞ": "groß", "STRAẞE": "straße"}),
    ("lowercase", "NLD", {"Ĳssel": "ĳssel"}),
    ("lowercase", "ELL", {"ΣΟΦΟΣ": "σοφοσ"}),
    ("case_fold", "DEU", {"ß": "ss", "Straße": "strasse", "GROẞ": "gross"}),
    ("case_fold", "NLD", {"IJ": "ij", "Ĳ": "ij", "ĳ": "ij", "IJssel": "ijssel"}),
    ("case_fold", "LIT", {"JĮ": "jį"}),
    ("case_fold", "ENG", {"NAÏVE": "naïve", "ß": "ß"}),
    ("transliterate", "DEU", {"Ä": "ae", "Größe": "Groeße"}),
    ("transliterate", "FRA", {"ŒUVRE Århus Straße": "oeUVRE Århus Straße", "Ça": "ca"}),
    ("transliterate", "DAN", {"ŒUVRE Århus Straße": "ŒUVRE aarhus Straße", "Ø": "oe"}),
    ("transliterate", "RUS", {"Щука ёж Яма": "Ščuka ëž Jama"}),
    ("remove_diacritics", "FRA", {"Crème brûlée": "Creme brulee"}),
    ("remove_diacritics", "VIE", {"Hà Nội": "Ha Noi", "Đạt": "Dat"}),
    ("remove_diacritics", "POL", {"Łódź": "Lodz"}),
    ("remove_diacritics", "CES", {"Příliš": "Prílis"}),
    ("remove_diacritics", "SLK", {"Ľúbica": "Lúbica"}),
    ("remove_diacritics", "SPA", {"Niño": "Niño"}),
    ("remove_diacritics", "POR", {"São Luís amanhã maçã": "Sao Luis amanha maca"}),
    ("remove_diacritics", "ITA", {"perché caffè città": "perche caffe citta"}),
    ("remove_diacritics", "ENG", {"café": "café"}),
    ("normalize_punctuation", "ENG", {"“Hello”": '"Hello"', "—dash—": "-dash-", "…": ".", "• bullet": "* bullet", "‹angle›": "<angle>"}),
    ("unify_width", "ENG", {"ＡＢＣ": "ABC", "！＠＃": "!@#", "　": " "}),
    ("remove_control_chars", "ENG", {"hello\u0001world": "helloworld", "a\u007fb\u0085c": "abc", "a\tb\n": "ab"}),
    ("remove_format_controls", "ENG", {"hello​world": "helloworld", "﻿text": "text", "a­b": "a­b"}),
    ("segment_words", "ZHO", {"Hello世界": "Hello 世界", "你好，世界！": "你好 ， 世界 ！", "Rust×中文＝强大": "Rust× 中文 ＝ 强大"}),
    ("segment_words", "JPN", {"東京2025年": "東京 2025 年", "最高の言語": "最高の言語"}),
    ("segment_words", "KOR", {"서울2025년": "서울 2025 년"}),
    ("segment_words", "THA", {"Helloสวัสดี": "Hello สวัสดี"}),
    ("segment_words", "ENG", {"Hello世界": "Hello世界"}),
]
WHITESPACE = [
    (" hello  world ", "normalize_whitespace_full", "hello world"),
    ("a\t\t\n\nb", "normalize_whitespace_full", "a b"),
    ("   a   b 　 ", "normalize_whitespace_full", "a b"),
    (" a b ", "collapse_whitespace", " a b "),
    ("a  b", "collapse_whitespace", "a  b"),
    (" a b ", "trim_whitespace", "a b"),
    (" a ", "trim_whitespace", " a "),
    (" hello world ", "trim_whitespace_unicode", "hello world"),
    ("a  b", "collapse_whitespace_unicode", "a b"),
    ("a b", NormalizeWhitespace(False, False, True), "a b"),
    ("a  b", NormalizeWhitespace().replace_whitespace_with("​"), "a​b"),
    (" a b ", NormalizeWhitespace(False, True, True, "-"), "a b"),
    ("a   b", "collapse_whitespace", "a   b"),
    ("a  b", NormalizeWhitespace().replace_whitespace_with("$"), "a$b"),
]
HTML = {
    "<h1>Title</h1><p>Text</p>": "Title Text", "Price: &euro;99": "Price: €99", "&lt;test&gt;": "", "<![Cdata[<tag>content</tag>]]>text": "<tag>content</tag>text",
    "<h1>A</h1><h2>B</h2>": "AB", "a<br>b": "ab", "3 < 5 and 7 > 2": "3  2", "<p>a</p><p>b</p>": "a b", "x<script src='>'>y</script>z": "xz", "<!-- a > b -->c": "c",
    "<a title='x > y'>t</a>": "t", "a <b": "a", " plain ": " plain ", "&unknown; &amp;": "&unknown; &", "&#65;&#x42;&#0x;": "AB&#0x;", "<?xml ?>a": "a", "<!DOCTYPE html>a": "a", "<svg/>x": "", "<STYLE>a</style >b": "b",
}
MARKDOWN = {
    "**bold**": "bold", "_italic_": "italic", "~~strike~~": "strike", "# Header": "Header", "`code`": "code", "`*text*`": "*text*", "[link](url)": "link", "- [x] Task": "[x] Task",
    "| A | B |\n| --- | --- |": "A B", "$E=mc^2$": "$E=mc^2$", "```rust\ncode\n```": "code",
    "| Header A | Header B |\n|----------|----------|\n| Cell 1 | Cell 2 |\n| Cell 3 | Cell 4 |": "Header A Header B\nCell 1 Cell 2\nCell 3 Cell 4",
    "# Heading 1\nParagraph text.\n## Heading 2\nMore text.": "Heading 1\nParagraph text.\nHeading 2\nMore text.", "- Item 1\n- Item 2\n  - Nested A\n  - Nested B": "Item 1\nItem 2\nNested A\nNested B",
    "Click [here](https://example.com) to see ![A Cat](cat.png).": "Click here to see A Cat.", "Text <div>HTML</div> $E=mc^2$ end.": "Text <div>HTML</div> $E=mc^2$ end.", "> a\n> b": "a\nb",
    "***both*** a*b*c **x": "both abc **x", "[a][ref] (b)\n\n[ref]: http://x": "a (b)", "text[^1] *x*\n\n[^1]: note": "text1 x\nnote", "snake_case *x*": "snake_case x", "1. one\n2. two": "one\ntwo",
    "Title\n===\n*x*": "Title\nx", "a\\*b* c": "a*b* c", "hello world": "hello world", "I ate 2. pizzas": "I ate 2. pizzas", "array[0]": "array[0]", "Title\n===": "Title\n===", "<http://a.b> *x*": "http://a.b x",
}
# End of fixed values.


@pytest.mark.parametrize(("name", "lang", "pairs"), GOLDEN)
def test_golden(spark, name, lang, pairs):
    assert run(spark, Pipeline.from_names([name], lang), [*pairs, None, ""]) == [*pairs.values(), None, ""]


def test_whitespace_matrix(spark):
    for text, stage, expected in WHITESPACE:
        assert run(spark, Pipeline.from_names([stage]), [text]) == [expected], (text, stage)


def test_html():
    assert {t: html.strip(t) for t in HTML} == HTML


def test_markdown():
    assert {t: markdown.strip(t) for t in MARKDOWN} == MARKDOWN


def test_indic(spark):
    texts = ["क्ष", "क्र", "नमस्ते"]
    assert run(spark, Pipeline.from_names(["segment_words"], "HIN"), texts) == ["क्​ष", "क्र", "नमस्​ते"]
    assert run(spark, Pipeline.from_names(["segment_words"], "BEN"), ["ক্র"]) == ["ক্​র"]


def test_unigram(spark):
    lang = language("ZHO").with_segment_rules(*SegmentRule)
    assert run(spark, Pipeline.from_names(["segment_words"], lang), ["Hello中华人民共和国", "最高の言語"]) == ["Hello 中 华 人 民 共 和 国", "最 高 の 言 語"]


def test_viramas():
    assert sorted(map(ord, charsets.VIRAMAS)) == sorted([0x94D, 0x9CD, 0xA4D, 0xACD, 0xB4D, 0xBCD, 0xC4D, 0xCCD, 0xD4D, 0xDCA, 0x103A, 0x17D2, 0x1BAA, 0x1B44])


def _random(seed: int, n: int = 250) -> list[str]:
    rng = random.Random(seed)
    ranges = [(0, 0x24F), (0x250, 0x52F), (0x590, 0x6FF), (0x900, 0xDFF), (0xE00, 0xEFF), (0x1000, 0x109F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x3000, 0x30FF), (0x4E00, 0x4E50), (0xAC00, 0xAC50), (0xFF00, 0xFF60), (0x20000, 0x20020), (0x1F600, 0x1F620)]
    special = " \t\n\x0b   　​‌‍“”—…İIΣẞßÅÆŒabcABC012्์"

    def char() -> str:
        return rng.choice(special) if rng.random() < 0.5 else chr(rng.randint(*rng.choice(ranges)))

    return ["".join(char() for _ in range(rng.randrange(14))) for _ in range(n)]


CHARACTER_STAGES = ["lowercase", "case_fold", "transliterate", "remove_diacritics", "normalize_punctuation", "unify_width", "remove_control_chars", "remove_format_controls"]


@pytest.mark.parametrize("name", CHARACTER_STAGES)
def test_characters_against_model(spark, name):
    # One job for all languages: each text under each.
    texts = _random(CHARACTER_STAGES.index(name))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    langs = all_languages() if name in CHARACTER_STAGES[:4] else [language("ENG")]
    rows = frame.select("i", *[Pipeline.from_names([name], x).col("text").alias(x.code) for x in langs]).collect()
    for row in rows:
        for lang in langs:
            assert row[lang.code] == getattr(oracle, name)(texts[row["i"]], lang), (lang.code, texts[row["i"]])


@pytest.mark.parametrize("name", ["normalize_whitespace_full", "collapse_whitespace", "collapse_whitespace_unicode", "trim_whitespace", "trim_whitespace_unicode"])
def test_whitespace_against_model(spark, name):
    w = REGISTRY[name]
    texts = _random(20) + ["".join(random.Random(i).choice(" \t\n\x0ba ") for _ in range(8)) for i in range(200)]
    assert run(spark, Pipeline((w,)), texts) == [oracle.whitespace(t, w.collapse, w.trim, w.normalize_unicode, w.replacement) for t in texts]


@pytest.mark.parametrize("code", ["ZHO", "HIN", "TAM", "THA", "KOR"])
def test_segment_against_model(spark, code):
    texts = _random(30, 500)
    one_way = language(code).with_segment_rules(SegmentRule.WESTERN_TO_SCRIPT)
    other_way = language(code).with_segment_rules(SegmentRule.SCRIPT_TO_WESTERN, SegmentRule.CJK_IDEOGRAPH_UNIGRAM)
    for lang in (language(code), one_way, other_way):
        assert run(spark, Pipeline.from_names(["segment_words"], lang), texts) == [oracle.segment(t, lang) for t in texts]


@pytest.mark.parametrize("form", ["nfc", "nfd", "nfkc", "nfkd"])
def test_forms(spark, form):
    texts = _random(40)
    assert run(spark, Pipeline.from_names([form]), [*texts, None]) == [*(unicodedata.normalize(form.upper(), t) for t in texts), None]


def test_fused_equals_sequential(spark):
    texts = [*_random(50), "Größe ŒUVRE Я Straße ẞ", None]
    for lang in ("DEU", "FRA", "RUS", "VIE", "TUR", "ZHO", "HIN", "HRV"):
        for names in (["case_fold", "transliterate"], ["transliterate", "lowercase", "remove_diacritics"], ["unify_width", "normalize_punctuation", "lowercase", "normalize_whitespace_full", "transliterate"], ["nfkc", "lowercase", "strip_html", "nfc"]):
            pipeline = Pipeline.from_names(names, lang)
            assert run(spark, pipeline, texts) == run(spark, pipeline, texts, fuse=False), (lang, names)


def test_idempotent(spark):
    texts = _random(60)
    for name in ("lowercase", "remove_diacritics", "normalize_whitespace_full", "segment_words", "unify_width", "nfkc"):
        pipeline = Pipeline.from_names([name], "ZHO")
        once = run(spark, pipeline, texts)
        assert run(spark, pipeline, once) == once, name


def test_presets_run(spark):
    texts = ["**café** ½-price", " <p>A&amp;B</p>  Ｃ ", None, ""]
    for name in [*PRESETS, "bert_like"]:
        got = run(spark, preset(name), texts)
        assert got[2] is None and got[3] == "", name
    assert run(spark, preset("search"), ["**café** ½-price"]) == ["café 1 ⁄ 2-price"] or run(spark, preset("search"), ["**café** ½-price"]) == ["café 1⁄2-price"]
    assert run(spark, preset("bert_like"), ["Héllo 世界"]) == ["hello  世  界 "]


def test_pipeline_api(spark):
    p = Pipeline().lang("TUR").add("trim_whitespace", "lowercase")
    assert run(spark, p, [" İSTANBUL  "]) == ["istanbul"] and p.uses_fusion
    assert not Pipeline.from_names(["nfc", "lowercase"]).uses_fusion and not Pipeline.from_names(["lowercase"]).uses_fusion
    assert run(spark, Pipeline(), ["Aé"]) == ["Aé"]
    changed = Pipeline.from_names(["transliterate"], "ENG").modify_lang(transliterate_map={"x": "ks"})
    assert run(spark, changed, ["xa"]) == ["ksa"] and run(spark, changed.lang("ENG"), ["xa"]) == ["xa"]
    with pytest.raises(ValueError):
        Pipeline().lang("XXX")
    with pytest.raises(ValidationError):
        Pipeline().add("no_such_stage")
    with pytest.raises(ValidationError):
        NormalizeWhitespace(replacement="ab")
    register(TextStage(str.title, "title"))
    from pyspark.sql import functions as F

    assert run(spark, Pipeline.from_names(["title", ColumnStage(lambda c: F.concat(c, F.lit("!")), "bang")]), ["ab"]) == ["Ab!"]


def test_needs_apply(spark):
    texts = ["plain", "Größe", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    p = Pipeline.from_names(["lowercase", "transliterate"], "DEU")
    assert [r["n"] for r in frame.select("i", p.needs_apply("text").alias("n")).orderBy("i").collect()] == [False, True, False, False]


def test_by_language(spark):
    frame = spark.createDataFrame([("Größe", "de"), ("Größe", "fr"), ("Größe", None)], "text string, lang string")
    p = Pipeline.from_names(["case_fold", "transliterate"])
    assert [r["t"] for r in frame.select(by_language(p, "text", "lang", ("de", "fr")).alias("t")).collect()] == ["groesse", "größe", "größe"]


def test_languages():
    sizes = {x.code: (len(x.case_map), len(x.fold_map), len(x.transliterate_map), len(x.precomposed_to_base), len(x.spacing_diacritics)) for x in all_languages()}
    assert len(sizes) == 34 and sizes["VIE"] == (0, 0, 0, 146, 5) and sizes["RUS"] == (0, 0, 66, 0, 0) and sizes["KHM"] == (0, 0, 0, 0, 31)
    assert find("tur") is language("TUR") and find("tr") is language("TUR") and find("xx") is None
    assert sum(x.needs_segmentation for x in all_languages()) == 10 and not any(x.unigram_cjk for x in all_languages())


def test_streaming(spark, tmp_path):
    from lingloom.streaming.normalize import normalize_stream

    spark.createDataFrame([("İSTANBUL",), (None,)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    normalize_stream(stream, Pipeline.from_names(["lowercase"], "TUR"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"istanbul", None}
    with pytest.raises(ValueError):
        normalize_stream(spark.range(1), Pipeline(), "x", "y")


def test_sql(spark):
    from lingloom.functions.sql import register_function, register_languages, register_view

    spark.createDataFrame([("<b>É</b>",)], "text string").createOrReplaceTempView("t")
    register_view(spark, "n", "t", Pipeline.from_names(["lowercase"]))
    register_function(spark, "strip_html", "strip_html")
    register_languages(spark)
    assert spark.sql("SELECT strip_html(normalized) AS x FROM n").first()["x"] == "é"
    assert spark.sql("SELECT count(*) AS n FROM languages").first()["n"] == 34


def test_plan_is_native(spark):
    frame = spark.createDataFrame([("a",)], "text string")
    plan = frame.select(Pipeline.from_names(["lowercase", "remove_diacritics", "unify_width", "normalize_whitespace_full", "segment_words"], "ZHO").col("text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
