"""Operators that SQL can't express, against slow and plain models of themselves."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from lingloom.llm import decontaminate, language_id, quality_classifier, toxicity


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


# Toxicity


def plain_words(text: str) -> list[str]:
    """Letters of each word (o for all beyond Latin), runs of single letters joined, short ones dropped, long ones in windows."""
    out: list[str] = []
    for word in re.split(r"[ \t-\r]+", text):
        letters = ""
        for c in word:
            plain = unicodedata.normalize("NFD", c.lower())[0]
            if plain.isascii() and plain.isalpha():
                letters += plain
        if word:
            out.append(letters)
    joined: list[str] = []
    i = 0
    while i < len(out):
        j = i
        while j < len(out) and len(out[j]) == 1:
            j += 1
        if j - i >= 3:
            joined.append("".join(out[i:j]))
            i = j
        else:
            joined.append(out[i])
            i += 1
    words = [w for w in joined if len(w) >= 3]
    long = [w for w in words if len(w) > toxicity.LONG]
    step = toxicity.WINDOW // 2
    return [w for w in words if len(w) <= toxicity.LONG] + [w[k : k + toxicity.WINDOW] for w in long for k in range(0, max(1, len(w) - step), step)]


def letters(code) -> str:
    return "".join(chr(97 + c) for c in code)


def test_words_of_toxicity():
    rng = random.Random(4)
    alphabet = "aaabcdeiouüéñÀ.-_ \n!?1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["i d i o t", "a b", "x" * 70, "", "i.d-i_o t", "a b c d", "ab c d e fg"]
    w = toxicity.find_words(*packed(texts))
    got = defaultdict(Counter)
    for which, doc in zip(w.which, w.doc, strict=True):
        got[int(doc)][letters(w.code[w.start[which] : w.stop[which]])] += 1
    assert [got[i] for i in range(len(texts))] == [Counter(plain_words(t)) for t in texts]


def plain_kernel(a: str, b: str) -> float:
    def grams(w: str) -> Counter:
        out: Counter = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    if k - i < toxicity.SPAN:
                        out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    x, y = grams(a), grams(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[g] for g, v in x.items()) / norm if norm else 0.0


def test_kernel_of_toxicity():
    """Words that the bound skips are below the floor with each marked landmark; all others have their kernels."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeo") for _ in range(rng.randrange(3, 12)))
    landmarks, marked = ["".join(x) for x in {word() for _ in range(9)}], 5
    words = [*{word() for _ in range(300)}, *landmarks]
    code = lambda s: bytes(ord(c) - 97 for c in s)
    kernel = toxicity.Kernel([code(x) for x in landmarks], marked)
    ends = np.cumsum([len(w) for w in words])
    some, values = kernel.words(np.frombuffer(b"".join(map(code, words)), np.uint8), ends - [len(w) for w in words], ends)
    want = np.array([[plain_kernel(w, x) for x in landmarks] for w in words])
    want[want < toxicity.FLOOR] = 0
    near = np.flatnonzero(want[:, :marked].any(1))
    assert some.tolist() == near.tolist() and np.allclose(values, want[near], atol=1e-5)


def test_sentences_of_toxicity():
    rng = random.Random(9)
    words = ["idiot", "idot", "morron", "moron", "haus", "garten", "i.d.i.o.t", "ibdiot"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ". ", "!\n"]) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    code = lambda s: bytes(ord(c) - 97 for c in s)
    marks = ["idiot", "moron", "hausen"]
    doc, k = toxicity.Kernel([code(x) for x in marks], 2).sentences(toxicity.find_words(*packed(texts)))
    got = sorted((int(d), *np.round(v, 5)) for d, v in zip(doc, k, strict=True))
    want = []
    for i, text in enumerate(texts):
        # A word belongs to the sentence in which it begins; an end inside a word begins the next one's.
        sentence, by = 0, defaultdict(list)
        for m in re.finditer(r"[^ \n]+|\n", text):
            if m[0].strip():
                by[sentence].append("".join(c for c in m[0] if c.isalpha()))
            sentence += len(re.findall(r"[.!?\n]", m[0]))
        for own in by.values():
            values = np.array([[plain_kernel(w, x) for x in marks] for w in own])
            values[values < toxicity.FLOOR] = 0
            values[~values[:, :2].any(1)] = 0
            if values.any():
                want.append((i, *np.round(values.max(0), 5)))
    assert np.allclose(np.array(got), np.array(sorted(want)), atol=1e-4)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_toxicity_by_language(spark):
    """Toxic documents of each language are caught in the held-out fold, and clean ones left alone."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted").collect()
    caught, all_, wrong, clean = Counter(), Counter(), 0, 0
    for r in scored:
        if r["toxic"]:
            all_[r["lang"]] += 1
            caught[r["lang"]] += r["predicted"]
        else:
            clean += 1
            wrong += r["predicted"]
    assert sum(caught.values()) >= 0.9 * sum(all_.values()) and wrong <= 0.03 * clean
    assert all(caught[x] >= 0.8 * n for x, n in all_.items() if n >= 5), (caught, all_)


# Decontamination


def plain_tokens(text: str) -> list[tuple[str, int]]:
    out = []
    for m in re.finditer(r"[0-9A-Za-z]+", text):
        word, kind = m[0].lower(), 0
        before = [x for x in re.finditer(r"[0-9A-Za-z]+", text[: m.start()])]
        if m[0][0].isupper() and before and not re.search(r"[.!?\n]", text[before[-1].end() : m.start()]):
            kind = decontaminate.NAME
        if word[0].isdigit() or word in decontaminate.NUMBERS:
            kind = decontaminate.NUMBER
        if word in decontaminate.UNITS:
            kind = decontaminate.UNIT
        out.append((word, kind))
    return out


def plain_find(item: str, text: str):
    x, y = plain_tokens(item), plain_tokens(text)
    n = min(len(x), decontaminate.WINDOW)
    if n < decontaminate.SHORT:
        return None

    def templates(tokens):
        out = defaultdict(set)
        for i in range(len(tokens) - n + 1):
            for named in (True, False):
                slot = [bool(k) and (named or k != decontaminate.NAME) for _, k in tokens[i : i + n]]
                if n >= decontaminate.LEAST and 2 * sum(slot) <= n:
                    out[tuple((k,) if s else w for (w, k), s in zip(tokens[i : i + n], slot, strict=True))].add(i)
        return out

    def exact(tokens):
        return {(i, tuple(w for w, _ in tokens[i : i + n])) for i in range(len(tokens) - n + 1) if n < decontaminate.LEAST or 2 * sum(k in (1, 2) for _, k in tokens[i : i + n]) > n}

    mine, theirs = templates(x), templates(y)
    shifts = defaultdict(set)
    for key, places in mine.items():
        for j in places:
            for i in theirs.get(key, ()):
                shifts[i - j].add(j)
    matched, changed = set(), False
    for shift, starts in sorted(shifts.items(), key=lambda s: s[0]):
        tokens = sorted({j + k for j in starts for k in range(n)})
        to, fine, differs = {}, True, False
        for j in tokens:
            (a, kind), (b, other) = x[j], y[j + shift]
            if a != b and (kind != other or not kind) or kind and to.setdefault((kind, a), b) != b:
                fine = False
                break
            differs |= a != b
        changed |= fine and differs
        matched |= set(tokens) if fine else {j + k for j in starts for k in range(n) if [w for w, _ in x[j : j + n]] == [w for w, _ in y[j + shift : j + shift + n]]}
    known = {w for _, w in exact(y)}
    for i, w in exact(x):
        if w in known:
            matched |= set(range(i, i + n))
    return (len(matched), changed) if matched and len(matched) >= min(decontaminate.ENOUGH, -(-len(x) // 2)) else None


def test_decontamination_plainly():
    rng = random.Random(5)
    vocabulary = "the cat buys red apples for Anna Peter and then sells boxes of km kg hours 3 5 12 seven one".split()
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice([".", "?", ""])
    found = 0
    for _ in range(500):
        item = sentence(rng.randrange(1, 25))
        words = item.split()
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(words))
            words[k] = rng.choice([rng.choice(vocabulary), str(rng.randrange(9)), words[k].upper()])
        copy = " ".join(words[rng.randrange(3) :])
        text = f"{sentence(rng.randrange(9))} {copy} {sentence(rng.randrange(9))} {rng.choice([copy, ''])}"
        got = [x[2:] for x in decontaminate.Index([0], [item]).find(*packed([text]))]
        want = plain_find(item, text)
        assert got == ([want] if want else []), (item, text)
        found += bool(want)
    assert 100 < found < 500


# Language


def test_grams_plainly():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abÄß éЖ世\U0001d400 1.\n") for _ in range(rng.randrange(20))) for _ in range(200)]
    got = np.concatenate([x for x, _ in language_id.counts(*packed(texts))])
    mask, a, b = (1 << 32) - 1, 0x9E3779B1, 0x85EBCA77
    want = np.zeros_like(got)
    for i, text in enumerate(texts):
        chars = [ord(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else 32 for c in text]
        for n in (1, 2, 3):
            for k in range(len(chars) - n + 1):
                gram = chars[k : k + n]
                if gram[0] == gram[-1] == 32:
                    continue
                h = gram[0] * a & mask
                if n > 1:
                    h = ((h ^ b) * a + gram[1] * b) & mask
                if n > 2:
                    h = ((h ^ a) * b + gram[2] * a) & mask
                want[i, ((h ^ h >> 15) * b & mask) >> 32 - 13] += 1
    assert language_id.DIM == 1 << 13 and (got == want).all()


def test_leader_plainly():
    """Follow the regularised leader, one coordinate at a time."""
    rng = np.random.default_rng(3)
    data = [(np.append(rng.choice(50, 8, replace=False), language_id.DIM), np.append(rng.random(8), 1.0), int(rng.integers(3))) for _ in range(30)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        return 0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + n[i, c] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(len(data)):
            index, value, y = data[r]
            scores = np.array([sum(v * weight(i, c) for i, v in zip(index, value, strict=True)) for c in range(3)])
            p = np.exp(scores) / np.exp(scores).sum()
            old = {(i, c): weight(i, c) for i in index for c in range(3)}
            for i, v in zip(index, value, strict=True):
                for c in range(3):
                    g = v * (p[c] - (c == y))
                    sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / alpha
                    z[i, c] += g - sigma * old[i, c]
                    n[i, c] += g * g
    got = language_id.ftrl(data, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    want = np.zeros_like(got)
    for i, c in list(z):
        want[i, c] = weight(i, c)
    assert np.allclose(got, want, atol=1e-9) and (got == 0).mean() > 0.5


# Quality


def test_features_plainly():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcAB 01\n#.!é|") for _ in range(rng.randrange(80))) for _ in range(100)] + ["", "a", "a a a", "x\nx\nx"]
    got = quality_classifier.features(*packed(texts))
    share = lambda x, n: np.log((x + 0.5) / max(n - x + 0.5, 0.5))
    for row, text in zip(got, texts, strict=True):
        raw = text.encode()
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
        sizes = [len(w) for w in words]
        mean = sum(sizes) / max(1, len(words))
        spread = sum(x * x for x in sizes) / max(1, len(words)) - mean**2
        want = [np.log1p(len(words)), np.log1p(mean), np.log1p(max(0, spread)), share(len(set(words)), len(words)), share(len(set(lines)), len(lines)), np.log1p(len(words) / max(1, len(lines)))]
        want += [share(sum(x in c for x in raw), len(raw)) for c in quality_classifier.CLASSES]
        assert np.allclose(row, want), text


def test_densities_plainly():
    rng = np.random.default_rng(2)
    x, y = np.concatenate([rng.normal(0, 1, (80, 4)), rng.normal(1, 2, (60, 4))]), np.repeat([0, 1], [80, 60])
    alpha, gamma = 0.3, 0.05
    model = quality_classifier.Discriminant(x, y, alpha, gamma)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (80 * cov[0] + 60 * cov[1]) / 140
    logs = []
    for c in (0, 1):
        own = (1 - alpha) * cov[c] + alpha * pooled
        own = (1 - gamma) * own + gamma * np.trace(own) / 4 * np.eye(4) + 1e-6 * np.eye(4)
        away = z - z[y == c].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(own), away) - 0.5 * np.log(np.linalg.det(own)) + np.log((y == c).mean()))
    assert np.allclose(model.margin(x), logs[1] - logs[0])
