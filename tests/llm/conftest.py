from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make themselves, on the input.
CLASHING = ["g", "h", "a", "b", "c", "n", "y", "w", "score", "n_words", "length", "rank", "bucket", "component_id", "kept", "held_out", "node", "text_"]


@pytest.fixture(scope="session")
def corpus(spark):
    """Frames of (doc_id, text) with plausible other columns and columns with clashing names."""

    def make(rows: list[tuple[int | None, str | None]], clash: bool = True):
        from pyspark.sql import functions as F

        rng = random.Random(5)
        full = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in rows]
        frame = spark.createDataFrame(full, DOCUMENTS)
        return frame.withColumns({c: F.lit(c) for c in CLASHING}) if clash else frame

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, ties, repeated rows, a very long text, other scripts, special tokens."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(80)
    near = base.split()
    near[40] = "zzz"
    rows = [(i, text(rng.randrange(1, 60))) for i in range(20)]
    rows += [(30, base), (31, base), (32, " ".join(near)), (33, base.upper()), (34, base + " more words here"), (35, base[: len(base) // 2])]
    rows += [(40, None), (41, ""), (42, " \n\t "), (None, base), (None, None), (43, "one"), (44, "one"), (45, "one two three"), (46, "x" * 5000), (47, text(6000))]
    rows += [(48, "Ünïcödé 世界 İstanbul’s don't 123 " * 5), (49, "a <|endoftext|> b"), (50, "line\n" * 40), (51, "\x1c\x00 control"), (30, base), (41, "")]
    return rows
