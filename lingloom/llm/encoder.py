"""Token ids of whole texts with the public word-BPE vocabulary, one vocabulary look-up per distinct unit of a chunk.

The tokenizer splits at white space, and between letters, digits and other signs, before it merges; it never merges
across such a border. Texts are therefore cut into units at borders that hold in any context, each distinct unit is
tokenized once, and ids are gathered by unit. A space-delimited word with an apostrophe or with characters other than
ASCII and plain Latin letters stays one unit; a text with a marker of special tokens is tokenized as a whole.
"""

from __future__ import annotations

import numpy as np

from .textbuf import SPACE, U64, byte_set, lower_table, span_hashes, spans

#: Units kept between chunks; beyond that many the cache starts anew.
CACHE_UNITS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.letters = _byte_letters()
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def text_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def unit_ids(self, unit: bytes) -> list[int]:
        text = unit.decode("utf-8", "replace")
        plain = text.lower() if unit.isascii() else self.tokenizer.normalizer.normalize_str(text)
        if plain.isalpha():
            return [t.id for t in self.tokenizer.model.tokenize(plain if unit.isascii() else plain.encode().decode("latin-1").translate(self.letters))]
        return self.text_ids(text)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of units."""
        kind = _kinds()[data]  # 0 space, 1 letter, 2 digit, 3 other ASCII, 4 first byte of a Latin letter, 5 anything else
        second = np.zeros(len(data), bool)
        lead = np.flatnonzero(kind[:-1] == 4) if len(data) > 1 else np.zeros(0, np.int64)
        a, b = data[lead], data[lead + 1]
        sign = (a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xC4) & (b == 0xB0)  # times, division; dotted I lowers to two characters
        second[lead[~sign] + 1] = True
        kind[lead[~sign]] = kind[lead[~sign] + 1] = 1
        odd = (kind >= 4) | (data == 39)
        words, ends = spans(kind != 0, offsets)
        if not len(words):
            return words, ends
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum(odd, out=count[1:])
        whole = count[ends] > count[words]
        border = np.zeros(len(data) + 1, bool)
        border[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        if whole.any():
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, words[whole], 1)
            np.add.at(inside, ends[whole], -1)
            border &= ~(np.cumsum(inside) > 0)
        border[words] = border[ends] = True
        border[offsets] = True
        points = np.flatnonzero(border)
        first = points[:-1]
        keep = kind[first] != 0
        return first[keep], points[1:][keep]

    def encode(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, their counts); without ``ids``, the first is empty."""
        folded = lower_table()[data]
        starts, stops = self._units(folded, offsets)
        hashes = span_hashes(folded, starts, stops)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_UNITS:
            self._reset()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == distinct[inner]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = folded.tobytes()
            got = [self.unit_ids(raw[a:b]) for a, b in zip(starts[where[new]].tolist(), stops[where[new]].tolist(), strict=True)]
            length = np.fromiter(map(len, got), np.int64, len(got))
            begin = len(self.pool) + np.cumsum(length) - length
            self.pool = np.concatenate([self.pool, np.fromiter((x for g in got for x in g), np.uint16, int(length.sum()))])
            slots = len(self.start) + np.arange(len(new))
            self.start, self.length = np.concatenate([self.start, begin]), np.concatenate([self.length, length])
            self.keys, self.slots = np.insert(self.keys, at[new], distinct[new]), np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][inverse]
        length = self.length[slot]
        ends = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        edge = ends[np.searchsorted(starts, offsets)]
        counts = np.diff(edge)
        special = self._special(data, offsets)
        flat = np.zeros(0, np.uint32)
        if ids:
            flat = self.pool[np.repeat(self.start[slot] - ends[:-1], length) + np.arange(ends[-1])].astype(np.uint32)
        if special:
            parts = [flat[edge[i] : edge[i + 1]] for i in range(len(counts))] if ids else []
            for i in special:
                own = np.array(self.text_ids(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
                counts[i] = len(own)
                if ids:
                    parts[i] = own
            flat = np.concatenate(parts) if ids else flat
        return flat, counts

    @staticmethod
    def _special(data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Documents with the opening of a special token."""
        at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
        return sorted(set((np.searchsorted(offsets, at, "right") - 1).tolist()))


def _kinds() -> np.ndarray:
    table = np.full(256, 3, np.uint8)
    table[byte_set(SPACE)] = 0
    table[65:91] = table[97:123] = 1
    table[48:58] = 2
    table[128:] = 5
    table[0xC3:0xC9] = 4
    return table
