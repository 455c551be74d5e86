"""Pipelines for common uses."""

from __future__ import annotations

from ..functions.languages import Language
from .pipeline import Pipeline

# The stages of each preset, in order.
PRESETS = {
    "ascii_fast": ["normalize_whitespace_full"],
    "machine_translation": ["nfkc", "remove_control_chars", "remove_format_controls", "normalize_punctuation", "normalize_whitespace_full"],
    "markdown_processing": ["nfkc", "strip_markdown", "remove_control_chars", "remove_format_controls", "normalize_whitespace_full"],
    "web_scraping": ["nfkc", "strip_html", "remove_control_chars", "remove_format_controls", "unify_width", "normalize_whitespace_full"],
    "search": ["nfkc", "lowercase", "case_fold", "remove_diacritics", "strip_html", "strip_markdown", "remove_format_controls", "normalize_whitespace_full", "segment_words"],
    "cjk_search": ["nfkc", "unify_width", "remove_format_controls", "remove_control_chars", "normalize_whitespace_full", "segment_words"],
    "minimum": ["nfkc", "remove_control_chars", "normalize_whitespace_full"],
    "maximum": ["nfkc", "lowercase", "case_fold", "remove_diacritics", "strip_html", "strip_markdown", "remove_format_controls", "remove_control_chars", "unify_width", "normalize_whitespace_full", "segment_words"],
    "social_media": ["nfkc", "strip_html", "strip_markdown", "lowercase", "case_fold", "remove_diacritics", "unify_width", "remove_control_chars", "remove_format_controls", "normalize_punctuation", "normalize_whitespace_full"],
}
PRESETS["custom_social_media"] = [*PRESETS["social_media"], "strip_emoji"]
#: Marks that the BERT-like preset removes from decomposed text.
BERT_MARKS = "̸̧̨̀́̂̈̊̋̌̏̑"
# End of fixed values.


def preset(name: str, lang: str | Language = "ENG") -> Pipeline:
    if name == "bert_like":
        stages = ["remove_control_chars", "collapse_whitespace_unicode", "bert_compat_chinese_chars", "nfd", "remove_diacritics", "lowercase"]
        return Pipeline.from_names(stages, "ZHO").modify_lang(spacing_diacritics=BERT_MARKS)
    return Pipeline.from_names(PRESETS[name], lang)
