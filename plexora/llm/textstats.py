"""Counts over whole texts, taken for many texts at once."""

from __future__ import annotations

import numpy as np

from plexora.llm.common import HashCache, mix64

#: The characters that end a word, and those counted as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_words", "n_distinct_words", "n_upper", "n_letters", "n_marks", "n_bangs", "n_bars", "n_chars"]


class TextStats:
    """texts -> one long array per name of NAMES; words are runs of other characters than SPACES."""

    def __init__(self) -> None:
        self.words = HashCache()

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        n = len(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        parts = [r.split() for r in raw]
        out = {k: np.zeros(n, dtype=np.int64) for k in NAMES}
        out["n_words"][:] = [len(p) for p in parts]
        out["n_chars"][:] = [len(t) for t in texts]
        out["word_chars"][:] = [len(t) - sum(map(t.count, SPACES)) for t in texts]
        out["n_symbols"][:] = [sum(map(r.count, SYMBOLS_BYTES)) for r in raw]
        out["n_bangs"][:] = [r.count(b"!") for r in raw]
        out["n_bars"][:] = [r.count(b"|") for r in raw]
        for k, t in enumerate(texts):
            lines = [x for x in t.split("\n") if x.strip(SPACES)]
            out["n_lines"][k], out["n_dup_lines"][k] = len(lines), len(lines) - len(set(lines))
        self._words(parts, out)
        self._letters(raw, out)
        return out

    def _words(self, parts: list[list[bytes]], out: dict[str, np.ndarray]) -> None:
        counts = out["n_words"]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return
        get = self.words.__getitem__
        flat = np.fromiter((h for p in parts for h in map(get, p)), dtype=np.uint64, count=total)
        doc = np.repeat(np.arange(len(parts)), counts)

        def per_doc(mask: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=mask, minlength=len(parts)).astype(np.int64)

        same = np.zeros(total, dtype=bool)
        same[1:] = (flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])
        out["n_same_words"][:] = per_doc(same)
        spread = mix64(doc.astype(np.uint64) + np.uint64(1))
        out["n_distinct_words"][:] = per_doc(self._first(flat ^ spread))
        if total >= 3:
            p = np.uint64(0x9E3779B97F4A7C15)
            windows = mix64((mix64(flat[:-2]) * p + flat[1:-1]) * p + flat[2:]) ^ spread[:-2]
            inside = doc[:-2] == doc[2:]
            order = np.argsort(windows, kind="stable")
            w, ok = windows[order], inside[order]
            new = np.r_[True, w[1:] != w[:-1]]
            group = np.cumsum(new) - 1
            often = np.bincount(group, weights=ok)[group] >= 2
            hit = np.zeros(total - 2, dtype=bool)
            hit[order] = often & ok
            covered = np.zeros(total, dtype=bool)
            for k in range(3):
                covered[k : total - 2 + k] |= hit
            out["n_repeat_words"][:] = per_doc(covered)

    @staticmethod
    def _first(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        first = np.zeros(len(keys), dtype=bool)
        first[order] = np.r_[True, keys[order][1:] != keys[order][:-1]]
        return first

    @staticmethod
    def _letters(raw: list[bytes], out: dict[str, np.ndarray]) -> None:
        b = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        starts = np.r_[0, ends[:-1]] if len(raw) else ends

        def per_doc(kinds: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(kinds[b], dtype=np.int64)]
            return sums[ends] - sums[starts]

        table = np.arange(256)
        upper = (table >= 65) & (table <= 90)
        letter = upper | ((table >= 97) & (table <= 122))
        mark = (table > 32) & (table < 127) & ~letter & ~((table >= 48) & (table <= 57))
        out["n_upper"][:], out["n_letters"][:], out["n_marks"][:] = per_doc(upper), per_doc(letter), per_doc(mark)


SYMBOLS_BYTES = [c.encode() for c in SYMBOLS]
