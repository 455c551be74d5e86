"""Token counts: rollups by source, language and tokenizer version, maintained from signed changes.

A batch of changes holds inserts (+1), deletes (-1) and revisions (the old count out, the new one in). ``Rollup.commit``
adds a batch's partial totals to a ledger in a folder, under the batch's id; committing an id again replaces nothing
and adds nothing, so a job that is repeated after a failure counts once. A batch is written to a folder of its own and
becomes part of the ledger by one small file, made only if no file of its name is there: of two writers one wins, on every
store that can make a file exclusively. Totals are sums over the ledger and never read documents again; ``compact`` folds the
batches so far into one, whose file keeps their ids.

Null text is the empty text; null sources and languages are groups of their own; repeated rows count each time; an
empty table has no totals.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import id_text, in_arrow
from .packing import encoder
from .textbuf import chunks, per_doc, words

KEYS = ["source", "lang", "version"]
TOTALS = ["n_docs", "n_tokens", "n_words", "n_bytes"]
VERSION = "word_bpe_49k/1"
#: The version whose tokens are the words.
WORDS = "words/1"


def count(docs: DataFrame, version: str = VERSION, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens, n_words, n_bytes) of each document."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            starts, _ = words(data, offsets)
            mark = np.zeros(len(data), np.int8)
            mark[starts] = 1
            tokens = per_doc(mark, offsets) if version == WORDS else encoder(path).encode(data, offsets, ids=False)[1]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "source", "lang")], pa.array([version] * part.num_rows, pa.string()), pa.array(tokens, pa.int64()), pa.array(per_doc(mark, offsets)), pa.array(np.diff(offsets))], ["doc_id", "source", "lang", "version", "n_tokens", "n_words", "n_bytes"])

    return in_arrow(id_text(docs, "source", "lang"), rows, "doc_id long, source string, lang string, version string, n_tokens long, n_words long, n_bytes long")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(1))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts out, new counts in; also moves documents between groups and tokenizer versions."""
    return deletes(old).unionByName(inserts(new))


def totals(changes: DataFrame) -> DataFrame:
    """Signed sums by key: combined before the shuffle, so a hot source sends one row per task."""
    docs = changes.withColumn("n_docs", F.lit(1).cast("long"))
    return docs.groupBy(*KEYS).agg(*[F.sum(F.col(t) * F.col("sign")).alias(t) for t in TOTALS])


class Rollup:
    """A ledger of committed batches in ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return sorted(n for n in names if n.startswith(prefix))

    def _read(self, name: str) -> dict:
        """What an entry says; nothing if its writer was lost between making and filling it."""
        stream = self._fs.open(self._path(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text else {}

    def _enter(self, name: str, entry: dict) -> bool:
        """Whether the entry was made; false if there is one already. An empty one counts for nothing and is replaced."""
        if self._fs.exists(self._path(name)):
            if self._read(name):
                return False
            self._fs.delete(self._path(name), False)
        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._path(name)):
                return False
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return True

    def committed(self) -> list[str]:
        return [n.removeprefix("batch-") for n in self._names("batch-") if self._read(n)]

    def _add(self, name: str, sums: DataFrame, entry: dict) -> bool:
        data = f"data-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{data}")
        if self._enter(name, entry | {"data": data}):
            return True
        self._fs.delete(self._path(data), True)  # another writer came first
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new; nothing of a batch counts before its entry."""
        if not re.fullmatch(r"[\w.]+", batch):
            raise ValueError(f"a batch id has letters, digits, dots and underscores only: {batch!r}")
        if batch in self.committed():
            return False
        return self._add(f"batch-{batch}", totals(changes), {"batch": batch})

    def _state(self) -> tuple[str | None, list[str], list[str]]:
        """(the last fold, the batches in it, data folders of it and of all later batches)."""
        folds = [n for n in self._names("fold-") if self._read(n)]
        last = self._read(folds[-1]) if folds else {"batches": []}
        folded = set(last["batches"])
        later = {b: self._read(f"batch-{b}")["data"] for b in self.committed() if b not in folded}
        return (folds[-1] if folds else None), sorted([*folded, *later]), [*([last["data"]] if folds else []), *later.values()]

    def _ledger(self, folders: list[str]) -> DataFrame:
        schema = ", ".join([f"{k} string" for k in KEYS] + [f"{t} long" for t in TOTALS])
        ledger = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return ledger.groupBy(*KEYS).agg(*[F.sum(t).alias(t) for t in TOTALS])

    def compact(self) -> bool:
        """Folds all committed batches into one table; readers go on with the old ones until it is entered. Whether it was."""
        last, batches, folders = self._state()
        number = int(last.removeprefix("fold-")) + 1 if last else 1
        return bool(folders) and self._add(f"fold-{number:09d}", self._ledger(folders), {"batches": batches})

    def totals(self) -> DataFrame:
        """Sums over all committed batches; groups whose documents are all gone have no row."""
        return self._ledger(self._state()[2]).where(F.col("n_docs") != 0)


#: Totals with words as tokens, of documents that have any, over the view ``documents``.
SQL = r"""
WITH d AS (SELECT source, lang, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS n, octet_length(encode(coalesce(text, ''))) AS b FROM documents)
SELECT source, lang, 'words/1' AS version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, sum(n)::BIGINT AS n_words, sum(b)::BIGINT AS n_bytes
FROM d WHERE n > 0 GROUP BY source, lang
"""
