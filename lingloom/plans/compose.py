"""Composition of stages into few expressions, before Spark sees a plan.

Stages that map single characters compose into one table: the images of g after f are g applied to each character of f's
images. A table becomes one ``translate``, preceded by a ``replace`` for each character with a longer image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.base import is_ascii

Table = dict[str, str]
#: Bytes of text that are Python's strings at a time.
CHUNK = 1 << 20


def compose(first: Table, then: Table) -> Table:
    """One table for ``first`` followed by ``then``; characters in neither table stay."""
    both = {c: "".join(then.get(x, x) for x in image) for c, image in first.items()}
    return {c: image for c, image in (then | both).items() if c != image}


def single_pass(table: Table) -> bool:
    """Whether no longer image holds a character that the table maps as well, so that one pass is enough."""
    return all(x not in table for image in table.values() if len(image) > 1 for x in image)


def _emit(col: Column, table: Table) -> Column:
    for c, image in table.items():
        if len(image) > 1:
            col = F.replace(col, F.lit(c), F.lit(image))
    kept = {c: image for c, image in table.items() if len(image) == 1}
    gone = "".join(c for c, image in table.items() if not image)
    if kept or gone:
        # Characters beyond the end of the second list are deleted.
        col = F.translate(col, "".join(kept) + gone, "".join(kept.values()))
    return col


def emit(col: Column, table: Table) -> Column:
    """The table as an expression. Texts that are all ASCII take the table's ASCII part, often nothing or plain lower case."""
    table = {c: image for c, image in table.items() if c != image}
    if not table:
        return col
    ascii_part = {c: image for c, image in table.items() if c.isascii()}
    if ascii_part == {chr(c): chr(c + 32) for c in range(65, 91)}:
        quick = F.lower(col)
    else:
        quick = _emit(col, ascii_part)
    return F.when(is_ascii(col), quick).otherwise(_emit(col, table))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: however often the body names it, the plan holds it once."""
    return F.transform(F.array(value), body)[0]


def in_batches(functions: Sequence[Callable[[str], str]]) -> Callable[..., Column]:
    """A column function: the functions one after the other on each text, in Arrow batches.

    Of a batch, about ``CHUNK`` bytes are Python's strings at a time, and their results go back before the next ones are
    read, so memory follows the batch as it came and its longest text, not the results.
    """
    steps = list(functions)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            # Texts that end in the same stretch of CHUNK bytes make a chunk: without its first text it is smaller than that.
            starts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(texts)]
            for start, end in zip(starts, starts[1:], strict=False):
                out = texts.slice(start, end - start).to_pylist()
                for i, text in enumerate(out):
                    if text is not None:
                        for step in steps:
                            text = step(text)
                        out[i] = text
                yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def in_python(col: Column, functions: Sequence[Callable[[str], str]], gates: Sequence[Callable[[Column], Column] | None] = ()) -> Column:
    """The functions one after the other, in one round trip of Arrow batches.

    If each has a gate, a native look that is false only where the function changes nothing, texts that pass none
    stay behind: no function would change them, so neither do all of them.
    """
    call = in_batches(functions)
    if not gates or None in gates:
        return call(col)
    some = reduce(Column.__or__, [gate(col) for gate in gates])
    return F.coalesce(call(F.when(some, col)), col)
