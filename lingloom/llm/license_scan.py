"""License scans: fuzzy search for short notices.

A notice that occurs with at most ``k`` edits holds one of its ``k + 1`` pieces unchanged (pigeonhole). The pieces
are exact seeds, found in the collapsed lower-case text; around each seed the ``regex`` library's bounded-error
matching verifies the edits and reports the span.

Every text is scanned whole. Null or empty text: no words, no places, empty labels, score 0. Rows are kept as they
are: repeated rows give repeated results, a null doc_id stays null, an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import id_text, in_arrow
from .textbuf import chunks, lower_table, spans

#: Phrases whose exact places are the base result.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices in collapsed words; one edit is allowed for every EDIT_EVERY characters.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
    "general public license": "gpl",
}
EDIT_EVERY = 10
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label:string,start:long,stop:long,edits:int>>"
)


@lru_cache(1)
def _word_table() -> np.ndarray:
    """Lower case; bytes outside words become a space."""
    table = lower_table().copy()
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    table[~keep] = 32
    return table


def pieces(notice: bytes, k: int) -> list[tuple[int, bytes]]:
    """``k + 1`` parts of nearly equal length with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _places(text: bytes, seed: bytes) -> Iterator[int]:
    at = text.find(seed)
    while at >= 0:
        yield at
        at = text.find(seed, at + 1)


class Scanner:
    """Compiled notices; ``scan`` finds base places and fuzzy spans in a chunk of documents."""

    def __init__(self, notices: dict[str, str] | None = None, edit_every: int = EDIT_EVERY) -> None:
        self.notices = []
        for text, label in (NOTICES if notices is None else notices).items():
            raw, k = text.encode(), len(text) // edit_every
            self.notices.append((raw, label, k, pieces(raw, k), regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(raw, literal_spaces=True), k))))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list], dict[int, list]]:
        """Word counts; {document: [(word, label)]} of base places; {document: [(label, start, stop, edits)]} in bytes."""
        norm = _word_table()[data]
        starts, stops = spans(norm != 32, offsets)
        first = np.searchsorted(starts, offsets)  # of each document, in words
        #: One space before each word and after the last: words of a document are a line of their own.
        lengths = stops - starts
        at = np.zeros(len(starts) + 1, np.int64)  # each word's place in the collapsed text
        np.cumsum(lengths + 1, out=at[1:])
        line = np.full(at[-1], 32, np.uint8)
        within = norm != 32
        move = np.repeat(at[:-1] - starts, lengths)
        line[np.flatnonzero(within) + move] = norm[within]
        line[at[first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= len(starts))]] - 1] = 10  # no match crosses a document's end
        text = line.tobytes()
        doc_of = lambda p: int(np.searchsorted(first, np.searchsorted(at, p, "right") - 1, "right")) - 1
        back = lambda p: (w := min(int(np.searchsorted(at, p, "right")) - 1, len(starts) - 1), int(starts[w] + min(p - at[w], lengths[w])))[1]
        base, fuzzy = defaultdict(list), defaultdict(list)
        for phrase, label in PHRASES.items():
            raw = phrase.encode()
            for p in _places(text, raw):
                if (not p or text[p - 1] in b" \n") and text[p + len(raw) : p + len(raw) + 1] in (b"", b" ", b"\n"):
                    w = int(np.searchsorted(at, p, "right")) - 1
                    d = doc_of(p)
                    base[d].append((w - int(first[d]), label))
        for raw, label, k, seeds, pattern in self.notices:
            seen: set[int] = set()
            for offset, seed in seeds:
                for p in _places(text, seed):
                    begin = p - offset
                    if begin in seen:
                        continue
                    seen.add(begin)
                    low = max(0, begin - k)
                    if (cut := text.rfind(b"\n", low, p)) >= 0:
                        low = cut + 1
                    high = min(len(text), begin + len(raw) + k)
                    if (cut := text.find(b"\n", p, high)) >= 0:
                        high = cut
                    if m := pattern.search(text, low, high):
                        span = (label, back(m.start()), back(m.end()), sum(m.fuzzy_counts))
                        fuzzy[doc_of(p)].append((span, 1 - span[3] / len(raw)))
        return np.diff(first), base, fuzzy


def _disjoint(found: set[tuple]) -> list[tuple]:
    """Of overlapping spans, those with fewest edits, then the longest."""
    kept: list[tuple] = []
    for s in sorted(found, key=lambda s: (s[3], s[1] - s[2], s[1], s[0])):
        if all(s[2] <= t[1] or s[1] >= t[2] for t in kept):
            kept.append(s)
    return kept


def scan(docs: DataFrame, notices: dict[str, str] | None = None, edit_every: int = EDIT_EVERY) -> DataFrame:
    """One row per document: word count, exact phrase places, labels, score and the byte spans of fuzzy notices.

    ``spans`` are byte offsets in the document's text; of overlapping finds the one with fewest edits stays, then the longest.
    ``score`` is 1 for an exact phrase, else the best share of a notice's characters that needed no edit, else 0.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, edit_every)
        for part, data, offsets in chunks(batch):
            counts, base, fuzzy = scanner.scan(data, offsets)
            out = {k: [None] * len(counts) for k in ("first_word", "last_word", "spans")} | {"n_base": [0] * len(counts), "score": [0.0] * len(counts), "base_labels": [""] * len(counts), "labels": [""] * len(counts)}
            out["spans"] = [[] for _ in counts]
            for d in base.keys() | fuzzy.keys():
                places, found = base.get(d, []), fuzzy.get(d, [])
                kept = _disjoint({s for s, _ in found})
                if places:
                    out["n_base"][d], out["first_word"][d], out["last_word"][d] = len(places), min(places)[0], max(places)[0]
                    out["base_labels"][d] = ",".join(sorted({label for _, label in places}))
                out["labels"][d] = ",".join(sorted({label for _, label in places} | {s[0] for s in kept}))
                out["score"][d] = 1.0 if places else max(x for _, x in found)
                out["spans"][d] = [dict(zip(("label", "start", "stop", "edits"), (s[0], s[1] - offsets[d], s[2] - offsets[d], s[3]), strict=True)) for s in sorted(kept, key=lambda s: s[1:])]
            schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())])))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id") if f.name == "doc_id" else pa.array(counts if f.name == "n_words" else out[f.name], f.type) for f in schema], schema=schema)

    return in_arrow(id_text(docs), rows, SCHEMA)


#: Word counts and exact phrases in SQL, over the view ``documents``.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: w[i:i + 1] = ['cc', 'by']) AS a,
    list_filter(range(1, len(w) + 1), lambda i: w[i:i + 2] = ['general', 'public', 'license']) AS b, list_filter(range(1, len(w) + 1), lambda i: w[i:i + 2] = ['all', 'rights', 'reserved']) AS c FROM d),
q AS (SELECT *, list_concat(list_concat(a, b), c) AS x FROM p)
SELECT doc_id, n::BIGINT AS n_words, len(x)::BIGINT AS n_base, list_min(x) - 1 AS first_word, list_max(x) - 1 AS last_word,
  array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda y: y IS NOT NULL), ',') AS base_labels
FROM q
"""
