"""Pipelines: stages under a language, as one column expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import languages
from ..functions.languages import DEFAULT, Language
from ..operators import chars, forms, html, markdown, segment, whitespace
from ..operators.base import Stage, ValidationError
from .compose import bind, compose, emit, in_python, single_pass

REGISTRY: dict[str, Stage] = {
    s.name: s
    for s in (
        chars.LowerCase(), chars.CaseFold(), chars.Transliterate(), chars.RemoveDiacritics(), chars.NormalizePunctuation(), chars.UnifyWidth(),
        chars.StripControlChars(), chars.StripFormatControls(), chars.StripEmoji(), chars.PadHan(), whitespace.NORMALIZE_WHITESPACE_FULL,
        segment.SegmentWords(), forms.NFC, forms.NFD, forms.NFKC, forms.NFKD, html.StripHtml(), markdown.StripMarkdown(),
    )
} | {
    "normalize_whitespace_full": whitespace.NORMALIZE_WHITESPACE_FULL, "collapse_whitespace": whitespace.COLLAPSE_WHITESPACE,
    "collapse_whitespace_unicode": whitespace.COLLAPSE_WHITESPACE_UNICODE, "trim_whitespace": whitespace.TRIM_WHITESPACE,
    "trim_whitespace_unicode": whitespace.TRIM_WHITESPACE_UNICODE,
    "strip_control": chars.StripControlChars(), "strip_format": chars.StripFormatControls(),
}


def stage(name: str | Stage) -> Stage:
    if isinstance(name, Stage):
        return name
    if (found := REGISTRY.get(name)) is None:
        raise ValidationError(name, "is not registered")
    return found


def register(own: Stage, name: str | None = None) -> Stage:
    """Makes a stage of one's own known by name."""
    REGISTRY[name or own.name] = own
    return own


@dataclass(frozen=True)
class Step:
    """An expression of a column; ``apply``'s second argument says whether it may name the column only once."""

    python: bool
    apply: Callable[[Column, bool], Column]

    def of_bound(self, col: Column) -> Column:
        return self.apply(col, False)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Pipeline:
    """Immutable; every method returns another pipeline. Without stages it is the identity."""

    stages: tuple[Stage, ...] = ()
    language: Language = languages.language(DEFAULT)

    @classmethod
    def from_names(cls, names: Iterable[str | Stage], lang: str | Language = DEFAULT) -> Pipeline:
        return cls(tuple(map(stage, names)), languages.language(lang))

    def lang(self, code: str | Language) -> Pipeline:
        """Changes made by ``modify_lang`` are dropped."""
        return replace(self, language=languages.language(code))

    def modify_lang(self, change: Callable[[Language], Language] | None = None, **tables: object) -> Pipeline:
        """Starts from the registered language each time, so two calls don't add up."""
        return replace(self, language=languages.language(self.language.code).modified(change, **tables))

    def add(self, *more: str | Stage) -> Pipeline:
        return replace(self, stages=self.stages + tuple(map(stage, more)))

    @property
    def uses_fusion(self) -> bool:
        """At least two stages, all of which are expressions or tables."""
        return len(self.stages) > 1 and all(s.fusable for s in self.stages)

    def steps(self, fuse: bool = True) -> list[Step]:
        """The pipeline as expressions to be applied in turn: stages that compose are one step."""
        if not fuse:
            return [Step(s.python(self.language) is not None, lambda col, once, s=s: s.column(col, self.language, gated=not once)) for s in self.stages]
        out: list[Step] = []
        table: dict[str, str] = {}
        functions: list[tuple[Callable[[str], str], Callable[[Column], Column] | None]] = []

        def flush() -> None:
            if table:
                out.append(Step(False, lambda col, once, t=dict(table): emit(col, t)))
                table.clear()
            if functions:
                calls, gates = zip(*functions, strict=True)
                out.append(Step(True, lambda col, once: in_python(col, calls, () if once else gates)))
                functions.clear()

        for s in self.stages:
            own, function = s.mapping(self.language), s.python(self.language)
            if own is not None:
                joined = compose(table, own)
                if functions or table and not single_pass(joined):
                    flush()
                    joined = own
                table = dict(joined)
            elif function is not None:
                if table:
                    flush()
                functions.append((function, s.gate(self.language)))
            else:
                flush()
                out.append(Step(False, lambda col, once, s=s: s.apply(col, self.language)))
        flush()
        return out

    def col(self, text: str | Column, fuse: bool = True) -> Column:
        """The whole pipeline on a column. ``fuse=False`` applies one stage after the other; the result is the same.

        A step names its input several times, so from the second step on the input is bound: the expression grows with
        the stages, not with their power.
        """
        col, plain = (F.col(text), True) if isinstance(text, str) else (text, False)
        for step in self.steps(fuse):
            # A call of Python can't be inside a bound expression, but it may be what is bound.
            col = step.apply(col, not plain) if plain or step.python else bind(col, step.of_bound)
            plain = False
        return col

    def needs_apply(self, text: str | Column) -> Column:
        """Whether any stage would change the text as it is."""
        col = F.col(text) if isinstance(text, str) else text
        needed = F.lit(False)
        for s in self.stages:
            needed = needed | s.needs_apply(col, self.language)
        return needed

    def transform(self, df: DataFrame, text: str = "text", out: str | None = None) -> DataFrame:
        """``df`` with the normalized text in ``out`` (or in place); batch and streaming frames alike.

        Each step is a projection of its own, which Spark keeps apart where the next one needs its result several times, so
        that all of it is compiled.
        """
        out, steps = out or text, self.steps()
        if not steps:
            return df.withColumn(out, F.col(_quoted(text)))
        for step in steps:
            df, text = df.withColumn(out, step.apply(F.col(_quoted(text)), False)), out
        return df


def by_language(pipeline: Pipeline, text: str, lang: str, codes: Iterable[str], otherwise: str = DEFAULT) -> Column:
    """The pipeline under the language that each row's ``lang`` column names; other rows under ``otherwise``."""
    col = pipeline.lang(otherwise).col(text)
    for code in codes:
        col = F.when(F.col(lang) == code, pipeline.lang(code).col(text)).otherwise(col)
    return col
