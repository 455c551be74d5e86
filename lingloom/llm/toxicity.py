"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words counts the three-letter subsequences they share, a gap weighted ``DECAY`` for each letter that
it skips, up to ``SPAN`` letters; it is normalised to one for equal words. Characters other than letters within a word
are dropped and runs of single letters are joined, so ``i.d-i_o t`` forms keep their subsequences; inserted letters
only lower them. A sentence's kernel with a landmark is that of its best word (0 below ``FLOOR``). Landmarks are words of
the labelled sentences that mark toxic documents beyond chance, however rare (the ``MARKED`` strongest at most), and their nearest clean words; sentences are mapped by K^(-1/2) of the
landmarks and a linear machine is trained on them with the hinge loss, the witness sentence of each toxic document
being chosen anew in each round. Stems (starts and ends of words) that clean documents hold as well, but rarely,
count by their number: a passage has the evidence of a Poisson likelihood ratio (``Stems``). A document's score is the
logistic of its worst sentence or passage, one half at the border that FALSE_RATE of the clean training documents exceed.

Only the training sample is bounded: ``limit`` labelled documents outside the held-out fold, ``SENTENCES``
sentences each, chosen by hash (a longer sentence counts as several of ``SENTENCE_BYTES``), ``TEXT_BYTES`` together.
Every whole text is scored; words longer than ``LONG`` letters are read in overlapping windows.

Null text is the empty text and scores as one without a marked word. Without labelled documents of both classes the
score is the share of label 1 (0 without labels). Repeated rows are all scored; a null doc_id counts in the fold of the
empty text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fitted, fold, id_text, in_arrow, labelled
from .textbuf import U64, Hashes, byte_set, chunks, lower_table, mix64, words

LIMIT, SENTENCES, SENTENCE_BYTES, TEXT_BYTES = 4_000, 64, 2_000, 32_000
DECAY, SPAN, FLOOR = 0.7, 6, 0.35
LONG, WINDOW = 24, 16
MARKED, NEAR, FORM = 128, 16, 5
#: Lengths of stems (starts and ends of words), and how often a document holds a stem at least.
STEMS, TIMES = range(4, 10), (1, 2, 3)
#: Chance, over all strings tested, that one of them is taken for a mark; strings that are looked at in detail.
ALPHA, CANDIDATES, BUCKETS = 0.05, 4096, 1 << 21
#: Largest evidence (log of a likelihood ratio) of one occurrence, and the least for a passage.
MOST, EVIDENCE = 6.0, 3.0
#: Kernel from which a word is taken for another form of the same word.
SAME = 0.8
#: Share of clean training documents that may lie above the border, where the score is one half.
FALSE_RATE = 0.002
LETTERS = 27
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


#: Plain letters of the two-byte characters from U+00C0 to U+00FF, in their order.
PLAIN = "aaaaaaaceeeeiiiidnooooo ouuuuyts"


def letter_codes(data: np.ndarray) -> np.ndarray:
    """a-z and their accented forms as 0-25, bytes of other letters as 26, everything else 255."""
    table = np.full(256, 255, np.uint8)
    table[97:123] = np.arange(26)
    table[128:] = 26
    code = table[lower_table()][data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    plain = np.array([255 if c == " " else ord(c) - 97 for c in PLAIN * 2], np.uint8)
    code[lead] = 255
    code[lead + 1] = plain[data[lead + 1] & 0x3F]
    return code


def grams(code: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(gram, word, weight) of the gapped three-letter subsequences of words laid end to end."""
    c = code.astype(np.int32)
    for a, b in PAIRS:
        if len(c) > b:
            at = np.flatnonzero(word[b:] == word[:-b])
            yield c[at] * (LETTERS * LETTERS) + c[at + a] * LETTERS + c[at + b], word[at], DECAY ** (b - 2)


def vectors(items: list[bytes]) -> np.ndarray:
    """Normalised feature vectors (words x grams) of a few words of letter codes."""
    x = np.zeros((len(items), LETTERS**3), np.float32)
    code = np.frombuffer(b"".join(items), np.uint8)
    word = np.repeat(np.arange(len(items)), [len(i) for i in items])
    for gram, owner, weight in grams(code, word):
        np.add.at(x, (owner, gram), weight)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass
class Words:
    """The words of a chunk: distinct ones as letter codes, and where each stands."""

    code: np.ndarray
    start: np.ndarray  # of distinct words in code
    stop: np.ndarray
    which: np.ndarray  # distinct word of each occurrence
    doc: np.ndarray
    sentence: np.ndarray  # numbered over the chunk, never shared by documents


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    begin, end = words(data, offsets)
    code = letter_codes(data)
    letter = code != 255
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=at[1:])
    compact = code[letter]
    doc = np.searchsorted(offsets, begin, "right") - 1
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(byte_set(b".!?\n")[data], out=stops[1:])
    sentence = stops[begin] + doc  # a border in the text or of documents
    start, stop = at[begin], at[end]
    single = (stop - start) == 1
    if single.any():  # runs of at least three single letters are one word
        # A run ends where the document does, so that a text's words don't depend on its neighbours.
        opens = single & np.concatenate([[True], ~single[:-1] | (doc[1:] != doc[:-1])])
        closes = single & np.concatenate([~single[1:] | (doc[1:] != doc[:-1]), [True]])
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        keep = last - first >= 3
        drop = np.zeros(len(begin), bool)
        for a, b in zip(first[keep], last[keep], strict=True):
            stop[a] = stop[b - 1]
            drop[a + 1 : b] = True
        start, stop, doc, sentence = start[~drop], stop[~drop], doc[~drop], sentence[~drop]
    ok = stop - start >= 3
    start, stop, doc, sentence = start[ok], stop[ok], doc[ok], sentence[ok]
    if (long := np.flatnonzero(stop - start > LONG)).size:
        more = [np.arange(start[i], max(start[i] + 1, stop[i] - WINDOW // 2), WINDOW // 2) for i in long]
        owner = np.repeat(long, [len(m) for m in more])
        begin_ = np.concatenate(more)
        start = np.concatenate([np.delete(start, long), begin_])
        stop = np.concatenate([np.delete(stop, long), np.minimum(begin_ + WINDOW, stop[owner])])
        doc = np.concatenate([np.delete(doc, long), doc[owner]])
        sentence = np.concatenate([np.delete(sentence, long), sentence[owner]])
    key = mix64(Hashes(compact).of(start, stop) + (stop - start).astype(U64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return Words(compact, start[first], stop[first], which, doc, sentence)


def strings(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, distinct words, keys): whole words (kind 0), starts (length) and ends (-length) of longer words."""
    hashes, length = Hashes(w.code), w.stop - w.start
    for kind in [0, *STEMS, *(-k for k in STEMS)]:
        some = np.flatnonzero(length > abs(kind)) if kind else np.arange(len(length))
        start = w.stop[some] + kind if kind < 0 else w.start[some]
        stop = w.start[some] + kind if kind > 0 else w.stop[some]
        yield kind, some, mix64(hashes.of(start, stop) + (stop - start).astype(U64) + U64((kind + 64) << 32))


def holdings(w: Words, some: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, occurrences) of the strings in ``n`` documents."""
    different, at = np.unique(keys, return_inverse=True)
    number = np.full(len(w.start), -1)
    number[some] = at
    of = number[w.which]
    pairs, times = np.unique(of[of >= 0] * n + w.doc[of >= 0], return_counts=True)
    return different[pairs // n], pairs % n, times


def likelihood(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood ratio of a string's documents (a of n1 toxic, b of n0 clean); 0 unless it marks the toxic ones."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    rate = np.maximum((a + b) / (n0 + n1), 1e-12)
    n1, n0 = max(n1, 1e-9), max(n0, 1e-9)
    ratio = 2 * (a * np.log(np.maximum(a, 1e-9) / (rate * n1)) + b * np.log(np.maximum(b, 1e-9) / (rate * n0)))
    return np.where(a > rate * n1, ratio, 0.0)


def forms(word: bytes, stems: set[tuple[int, int]]) -> set:
    """What words of one cluster share: a stem, or the start or the end of FORM letters."""
    code, n = np.frombuffer(word, np.uint8), np.zeros(1, np.int64)
    own = {(kind, int(k)) for kind, _, keys in strings(Words(code, n, n + len(code), n, n, n)) for k in keys}
    return own & stems | {b"<" + word[:FORM], b">" + word[-FORM:]}


def once(texts: list[bytes]) -> list[bytes]:
    """The texts without sentences that an earlier one has: copies are no further evidence."""
    seen: set[bytes] = set()
    out = []
    for text in texts:
        own = [p for p in re.split(rb"(?<=[.!?\n])", text) if p.strip() not in seen]
        seen |= {p.strip() for p in own}
        out.append(b"".join(own))
    return out


def border_of_chance(total: np.ndarray, n1: int, n0: int) -> float:
    """Likelihood ratio that a chance string exceeds with ALPHA at most, among those frequent enough to reach it."""
    reach = np.sort(2 * total * np.log((n0 + n1) / n1))
    border = 4.0
    while (need := 2 * np.log(max(1, len(reach) - np.searchsorted(reach, border)) / ALPHA)) > border:
        border = min(need, border + 0.25)
    return float(border)


@dataclass
class Stems:
    """Strings that mark toxic documents by how often they occur: weights by key, and the rate of them all.

    Evidence of a passage (a run of sentences) is the Poisson likelihood ratio of its marked words at the rate of toxic
    documents, so that a string that clean texts hold now and then counts only where it is dense.
    """

    kinds: list[int]
    keys: np.ndarray  # sorted
    weights: np.ndarray
    rate: float
    least: float = EVIDENCE

    def evidence(self, w: Words, n: int) -> np.ndarray:
        """Of each document's strongest passage; 0 without a marked word."""
        best = np.zeros(len(w.start))
        for kind, some, keys in strings(w):
            if kind in self.kinds:
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                best[some] = np.maximum(best[some], np.where(self.keys[at] == keys, self.weights[at], 0))
        out = np.zeros(n)
        value = best[w.which]
        held = np.unique(w.doc[value > 0])
        if not len(held):
            return out
        keep = np.isin(w.doc, held)
        order = np.lexsort((w.sentence[keep], w.doc[keep]))
        sentence, doc, value = w.sentence[keep][order], w.doc[keep][order], value[keep][order] - self.rate
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        total, owner = np.add.reduceat(value, first), doc[first]
        run, at = np.cumsum(total), np.flatnonzero(np.diff(owner, prepend=-1))
        before = run - total
        for a, b in zip(at, [*at[1:], len(owner)], strict=True):
            out[owner[a]] = max(0.0, float((run[a:b] - np.minimum.accumulate(before[a:b])).max()))
        return out

    def over(self, evidence: np.ndarray) -> np.ndarray:
        """Evidence beyond the least, in units of it; far below without any."""
        return np.where(evidence > 0, (evidence - self.least) / self.least, -9.0)


def find_marks(parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[list[bytes], Stems | None]:
    """Words that mark toxic documents, and stems that do so by their number.

    A string is tested by the documents that hold it at least once, twice or three times. Of the stems beyond chance
    the strongest is taken, the toxic documents that it explains are set aside, and so on until none is beyond chance in
    the documents that are left. Words beyond chance are all marks, however rare beside others, unless clean documents hold them.
    """
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    bits = len(TIMES)

    def pieces() -> Iterator[tuple[Words, np.ndarray, int]]:
        done = 0
        for d, o in parts:
            yield find_words(d, o), y[done : done + len(o) - 1], done
            done += len(o) - 1

    # Documents by bucket of strings: at least those of any string in it, so that few strings are counted one by one.
    total, toxic = {w: np.zeros(BUCKETS, np.int32) for w in (True, False)}, {w: np.zeros(BUCKETS, np.int32) for w in (True, False)}
    for w, label, _ in pieces():
        for kind, some, keys in strings(w):
            key, doc, _ = holdings(w, some, keys, len(label))
            at = (key & U64(BUCKETS - 1)).astype(np.int64)
            total[kind == 0] += np.bincount(at, minlength=BUCKETS).astype(np.int32)
            toxic[kind == 0] += np.bincount(at[label[doc] == 1], minlength=BUCKETS).astype(np.int32)
    chance = {w: border_of_chance(t[t > 0], n1, n0) for w, t in total.items()}
    least_toxic = {w: c / (2 * np.log((n0 + n1) / n1)) for w, c in chance.items()}
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w, label, _ in pieces():
        for kind, some, keys in strings(w):
            ok = toxic[kind == 0][(keys & U64(BUCKETS - 1)).astype(np.int64)] >= least_toxic[kind == 0] - 1e-9
            key, doc, times = holdings(w, some[ok], keys[ok], len(label))
            old, table = tables.get(kind, (np.zeros(0, U64), np.zeros((0, 2 * bits), np.int32)))
            both, at = np.unique(np.concatenate([old, key]), return_inverse=True)
            new = np.zeros((len(both), 2 * bits), np.int32)
            new[at[: len(old)]] = table
            for m, least in enumerate(TIMES):
                held = times >= least
                for c in (0, 1):
                    new[:, 2 * m + c] += np.bincount(at[len(old) :][held & (label[doc] == c)], minlength=len(both)).astype(np.int32)
            tables[kind] = both, new
    del total, toxic

    chosen: list[tuple[float, int, int, int]] = []  # (ratio, kind, key, times)
    for word in (True, False):
        found = []
        for kind, (keys, table) in tables.items():
            if (kind == 0) != word:
                continue
            ratios = np.stack([likelihood(table[:, 2 * m + 1], table[:, 2 * m], n1, n0) for m in range(1 if word else bits)], 1)
            best = ratios.argmax(1)
            ratio = ratios.max(1)
            found += [(float(ratio[i]), kind, int(keys[i]), TIMES[best[i]]) for i in np.flatnonzero(ratio >= chance[word])]
        chosen += sorted(found, reverse=True)[:CANDIDATES]
    tables.clear()
    if not chosen:
        return [], None
    number = {(k, key): i for i, (_, k, key, _) in enumerate(chosen)}
    wanted = np.sort(np.array([key for _, _, key, _ in chosen], U64))
    count = np.zeros((len(chosen), len(y)), np.uint16)
    texts: dict[int, bytes] = {}
    size = np.zeros(len(y))
    for w, label, done in pieces():
        size[done : done + len(label)] = np.bincount(w.doc, minlength=len(label))
        for kind, some, keys in strings(w):
            ok = np.isin(keys, wanted)
            if ok.any():
                some, keys = some[ok], keys[ok]
                for key, doc, times in zip(*holdings(w, some, keys, len(label)), strict=True):
                    count[number[kind, int(key)], done + doc] = min(times, 65535)
                if not kind:
                    texts.update((number[kind, int(k)], w.code[w.start[i] : w.stop[i]].tobytes()) for i, k in zip(some, keys, strict=True))
    stems = [i for i, c in enumerate(chosen) if c[1]]
    holds = np.stack([count[i] >= chosen[i][3] for i in stems]) if stems else np.zeros((0, len(y)), bool)
    length = np.array([abs(chosen[i][1]) for i in stems])
    left, use = y == 1, []
    while len(stems) and left.any():
        ratio = likelihood(holds[:, left].sum(1), holds[:, y == 0].sum(1), int(left.sum()), n0)
        k = int(np.lexsort((length, ratio))[-1])
        if ratio[k] < chance[False]:
            break
        use.append(stems[k])
        left = left & ~holds[k]
    # A word that more than FALSE_RATE of the clean documents hold is no mark by itself; of words with the same start or end one is a landmark.
    word_list = [i for i, c in enumerate(chosen) if not c[1] and (count[i, y == 0] > 0).sum() <= max(1, FALSE_RATE * n0)]
    use += word_list
    marks, seen, shared = [], set(), {(chosen[i][1], chosen[i][2]) for i in use if chosen[i][1]}
    for i in word_list:
        own = forms(texts[i], shared)
        if not own & seen:
            marks.append(i)
            seen |= own
    weights = []
    for i in use:
        c, least = count[i].astype(float), chosen[i][3]
        toxic, clean = (y == 1) & (c >= least), (y == 0) & (c > 0)
        p1 = c[toxic].sum() / max(1.0, size[toxic].sum())
        p0 = c[clean].sum() / size[clean].sum() if clean.any() else 0.5 / max(1.0, size[y == 0].sum())
        weights.append(float(np.clip(np.log(p1 / p0), 0.0, MOST)) if p1 > 0 else 0.0)
    any_ = np.maximum.reduce([count[i] for i in use]).astype(float)
    toxic = (y == 1) & (any_ > 0)
    rate = float(any_[toxic].sum() / size[toxic].sum())
    keys = np.array([chosen[i][2] for i in use], U64)
    order = np.argsort(keys)
    return [texts[i] for i in marks[:MARKED]], Stems(sorted({chosen[i][1] for i in use}), keys[order], np.array(weights)[order], rate)


def distinct(marked: list[bytes], parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> list[bytes]:
    """The marks whose near forms (kernel from SAME on) at most FALSE_RATE of the clean documents hold."""
    if not marked:
        return []
    kernel, done = Kernel(marked, len(marked)), 0
    clean = np.zeros(len(marked), np.int64)
    for d, o in parts:
        doc, k = kernel.sentences(find_words(d, o))
        doc, k = doc[y[done + doc] == 0], k[y[done + doc] == 0] >= SAME
        row, mark = np.nonzero(k)
        clean += np.bincount(np.unique(doc[row] * len(marked) + mark) % len(marked), minlength=len(marked))
        done += len(o) - 1
    return [m for m, c in zip(marked, clean, strict=True) if c <= max(1, FALSE_RATE * (y == 0).sum())]


@dataclass
class Kernel:
    """Kernels of words with the landmarks, for words that reach FLOOR with one of the first ``marked`` of them.

    The sum of each gram's largest entry bounds a word's kernels, so that most words are skipped after one look-up a gram.
    """

    landmarks: list[bytes]
    marked: int
    matrix: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.matrix = vectors(self.landmarks)
        self.most = self.matrix[: self.marked].max(0, initial=0)

    def words(self, code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the near words, their kernels); kernels below FLOOR are 0."""
        length = stop - start

        def gather(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = length[some]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return code[np.repeat(start[some], n) + within], np.repeat(np.arange(len(some)), n)

        bound, norm = np.zeros(len(length)), np.zeros(len(length))
        for gram, owner, weight in grams(*gather(np.arange(len(length)))):
            bound += weight * np.bincount(owner, self.most[gram], minlength=len(length))
            norm += weight * weight * np.bincount(owner, minlength=len(length))
        some = np.flatnonzero((bound >= FLOOR * np.sqrt(norm) - 1e-6) & (norm > 0))
        if not len(some):
            return some, np.zeros((0, len(self.landmarks)))
        found = list(grams(*gather(some)))
        gram, owner = np.concatenate([g for g, _, _ in found]), np.concatenate([o for _, o, _ in found])
        weight = np.repeat([w for _, _, w in found], [len(g) for g, _, _ in found])
        cell, at = np.unique(owner * LETTERS**3 + gram, return_inverse=True)
        value = np.bincount(at, weight)
        owner, gram = cell // LETTERS**3, cell % LETTERS**3
        k = np.stack([np.bincount(owner, value * row[gram], minlength=len(some)) for row in self.matrix], 1)
        k /= np.sqrt(np.bincount(owner, value * value, minlength=len(some)))[:, None]
        k[k < FLOOR] = 0
        ok = k[:, : self.marked].any(1)
        return some[ok], k[ok]

    def sentences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(document, kernels) of the sentences with a near word; all others have zeros."""
        ids, near = self.words(w.code, w.start, w.stop)
        row = np.full(len(w.start), -1)
        row[ids] = np.arange(len(ids))
        hit = np.flatnonzero(row[w.which] >= 0)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        k = near[row[w.which[hit]]]
        order = np.argsort(w.sentence[hit], kind="stable")
        hit, k = hit[order], k[order]
        first = np.flatnonzero(np.diff(w.sentence[hit], prepend=-1))
        return w.doc[hit[first]], np.maximum.reduceat(k, first, axis=0)


def squash(margins: np.ndarray) -> np.ndarray:
    """Margins as calibrated: beyond the hinge, order still counts but hardly weighs."""
    return np.clip(margins, -1, 1) + 0.02 * np.tanh(margins)


class Model:
    """f(sentence) = weights . kernels + bias; the score is the calibrated logistic of the worst sentence."""

    def __init__(self, landmarks: list[bytes], marked: int, weights: np.ndarray, bias: float, slope: float, shift: float, stems: Stems | None = None, border: float = 0.0) -> None:
        self.landmarks, self.marked, self.weights, self.bias, self.slope, self.shift = landmarks, marked, weights, bias, slope, shift
        self.stems, self.border = stems, border
        self.kernel = Kernel(landmarks, marked)

    def __reduce__(self) -> tuple:
        return Model, (self.landmarks, self.marked, self.weights, self.bias, self.slope, self.shift, self.stems, self.border)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = find_words(data, offsets)
        worst = np.full(len(offsets) - 1, self.bias)
        doc, k = self.kernel.sentences(w)
        np.maximum.at(worst, doc, k @ self.weights + self.bias)
        if self.stems is not None:
            worst = np.maximum(worst, self.border + self.stems.over(self.stems.evidence(w, len(offsets) - 1)))
        return worst

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.slope * squash(self.margins(data, offsets)) - self.shift))


def machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> tuple[np.ndarray, float]:
    """A linear machine with weighted squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.column_stack([z, np.ones(len(z))])
    weight = weight / weight.sum()
    penalty = ridge * np.diag([*np.ones(z.shape[1]), 1e-3])
    w = np.zeros(x.shape[1])
    loss = lambda w: (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + w @ penalty @ w
    for _ in range(steps):
        on = weight * (y * (x @ w) < 1)
        to = np.linalg.solve(x.T @ (on[:, None] * x) + penalty, x.T @ (on * y))
        rate = 1.0
        while rate > 1e-4 and loss(w + rate * (to - w)) > loss(w):
            rate /= 2
        if rate <= 1e-4 or np.abs(to - w).max() < 1e-9:
            break
        w = w + rate * (to - w)
    return w[:-1], float(w[-1])


def _platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -35, 35)))
        s = p * (1 - p) + 1e-6
        g = np.array([((p - y) * f).sum() + 0.01 * a, (p - y).sum()])
        h = np.array([[(s * f * f).sum() + 0.01, (s * f).sum()], [(s * f).sum(), s.sum()]])
        step = np.clip(np.linalg.solve(h + 1e-6 * np.eye(2), g), -1, 1)
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def _spread(item: bytes, rng: np.random.Generator) -> bytes:
    """The word with one or two letters inserted inside."""
    out = list(item)
    for _ in range(rng.integers(1, 3)):
        out.insert(rng.integers(1, len(out)), int(rng.integers(0, 26)))
    return bytes(out)


def fit(texts: list[bytes], labels: list[int]) -> Model | float:
    y = np.array(labels, int)
    if not (y == 1).any() or not (y == 0).any():
        return float(y.mean()) if len(y) else 0.0
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    parts = [(o[:-1], d, o) for o, d in _pieces(data, offsets)]
    single = once(texts)
    marked, stems = find_marks([(d, o) for o, d in _pieces(np.frombuffer(b"".join(single), np.uint8), np.cumsum([0, *map(len, single)]))], y)
    del single
    marked = distinct(marked, [(d, o) for _, d, o in parts], y)
    if not marked and stems is None:
        return float(y.mean())
    counts: dict[bytes, list[int]] = {}
    done = 0
    for _, d, o in parts:
        w = find_words(d, o)
        n = len(o) - 1
        pairs = np.unique(w.which * n + w.doc)
        toxic = np.bincount(pairs // n, y[done + pairs % n], minlength=len(w.start)).astype(int)
        total = np.bincount(pairs // n, minlength=len(w.start))
        for i in range(len(w.start)):
            count = counts.setdefault(w.code[w.start[i] : w.stop[i]].tobytes(), [0, 0])
            count[1] += int(toxic[i])
            count[0] += int(total[i] - toxic[i])
        done += n
    clean = [i for i, c in counts.items() if c[0] >= max(1, c[1])]
    ends = np.cumsum([len(i) for i in clean])
    at, near = Kernel(marked, len(marked)).words(np.frombuffer(b"".join(clean), np.uint8), ends - [len(i) for i in clean], ends)
    nearest = [clean[at[i]] for i in np.argsort(-near.max(1, initial=0), kind="stable")[:NEAR]]
    landmarks = marked + nearest
    kernel = Kernel(landmarks, len(marked))
    docs, k, done = [], [], 0
    for _, d, o in parts:
        doc, values = kernel.sentences(find_words(d, o))
        docs.append(doc + done)
        k.append(values)
        done += len(o) - 1
    doc, k = np.concatenate(docs), np.concatenate(k)
    gram = kernel.matrix @ kernel.matrix.T
    values, basis = np.linalg.eigh(gram.astype(float))
    root = basis @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ basis.T
    rng = np.random.default_rng(11)
    spread = vectors([_spread(i, rng) for i in marked for _ in range(20)]) @ kernel.matrix.T
    spread[spread < FLOOR] = 0
    whole = kernel.matrix[: len(marked)] @ kernel.matrix.T
    whole[whole < FLOOR] = 0
    zero = np.zeros((1, len(landmarks)))
    clean_rows = k[y[doc] == 0]
    marked_part = k[:, : len(marked)].max(1, initial=0)
    weights, bias = np.zeros(len(landmarks)), 0.0 if marked else -1.0
    for _ in range(3 if marked else 0):  # stems alone need no machine
        f = k @ weights + bias if weights.any() else marked_part
        toxic = np.flatnonzero(y[doc] == 1)
        order = toxic[np.lexsort((-f[toxic], doc[toxic]))]
        witness = order[np.diff(doc[order], prepend=-1) != 0]
        parts_ = [(k[witness], 1, 1.0), (whole, 1, 1.0), (spread, 1, 0.3), (clean_rows, -1, 4.0), (zero, -1, 1.0)]
        rows = np.concatenate([x for x, _, _ in parts_])
        target = np.concatenate([np.full(len(x), float(t)) for x, t, _ in parts_])
        mass = np.concatenate([np.full(len(x), m / max(1, len(x))) for x, _, m in parts_])  # of each kind, however many
        w, bias = machine(rows @ root, target, mass)
        weights = root @ w
    model = Model(landmarks, len(marked), weights, float(bias), 1.0, 0.0)
    margins = np.concatenate([model.margins(d, o) for _, d, o in parts])
    border = min(0.95, max(0.0, float(np.quantile(margins[y == 0], 1 - FALSE_RATE))))
    if stems is not None:
        evidence = np.concatenate([stems.evidence(find_words(d, o), len(o) - 1) for _, d, o in parts])
        stems.least = max(EVIDENCE, float(np.quantile(evidence[y == 0], 1 - FALSE_RATE)))
        model.stems, model.border = stems, border
        margins = np.maximum(margins, border + stems.over(evidence))
    model.slope, _ = _platt(squash(margins), y)
    model.shift = -model.slope * float(squash(np.array([border]))[0])
    return model


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield offsets[start : stop + 1] - offsets[start], data[offsets[start] : offsets[stop]]
        start = stop


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LIMIT) -> Model | float:
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for text in batch.column("text").to_pylist():
            whole = [p.encode() for p in re.split(r"(?<=[.!?\n])", text or "") if p.strip()]
            parts = [p[k : k + SENTENCE_BYTES] for p in whole for k in range(0, len(p), SENTENCE_BYTES)]
            if len(parts) > SENTENCES:
                keep = sorted(range(len(parts)), key=lambda i: (zlib.crc32(parts[i]), i))[:SENTENCES]
                parts = [parts[i] for i in sorted(keep)]
            texts.append(b"".join(parts)[:TEXT_BYTES])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(texts, pa.binary())], ["doc_id", "y", "text"])

    def learn(got: pa.Table) -> Model | float:
        got = got.sort_by("doc_id")
        return fit(got["text"].to_pylist(), got["y"].to_pylist())

    return fitted(in_arrow(labelled(docs, labels, label, limit), rows, "doc_id long, y int, text binary"), learn)


def _scores(model: Model | float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return model.score(data, offsets) if isinstance(model, Model) else np.full(len(offsets) - 1, float(model))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LIMIT, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels, label, limit)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            p = _scores(model, data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = id_text(docs).withColumn("held_out", fold() == F.lit(0))
    return in_arrow(held, rows, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LIMIT, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, that score below the threshold: no join, no shuffle."""
    model = train(docs, labels, label, limit)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            yield part.filter(pa.array(_scores(model, data, offsets) < threshold))

    return docs.mapInArrow(lambda batches: (out for batch in batches for out in rows(batch)), docs.schema)
