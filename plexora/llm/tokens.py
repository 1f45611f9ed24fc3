"""Token ids of the public tokenizers, word by word with a bounded memory of the words already seen.

The vocabulary files lie outside the repository; their path is a parameter.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than a blank and \n, for a regular expression's class.
SPACE = "\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: What a cut before or after a word isn't exact at: there white space would touch the blank. A word behind a line's end begins with it.
LOOSE_BEGIN, LOOSE_END = f"^(\n?[{SPACE}]|$)", f"([\n{SPACE}]|^)$"
#: A letter or digit, behind which marks are a run of their own; not U+0130, whose lower case ends with a mark.
BEFORE_MARKS = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f]$"
#: How the two kinds of vocabulary file treat a text before the model: (normalizer, pre_tokenizer). Texts of others are not cut.
LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = (None, LEVEL)
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [SPLIT, LEVEL | {"use_regex": False}]},
)
#: Parts that both kinds give to the model as they are, but for the byte alphabet: letters that are their own NFC and, for WORDS, lower case.
PLAIN_BYTES, PLAIN_WORDS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153]+"), re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0153]+")


def byte_letters() -> str:
    """The characters that stand for each byte in byte-level vocabularies; the line's end stays itself."""
    shown, other = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    letters = [chr(b if b in shown else next(other)) for b in range(256)]
    letters[10] = "\n"
    return "".join(letters)


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


def gather(data: np.ndarray, sizes: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the units are one after the other, and the size of each; data holds all units, which have these sizes."""
    n = sizes[units]
    ends = np.cumsum(n)
    at = np.repeat((np.cumsum(sizes) - sizes)[units] - (ends - n), n)
    at += np.arange(len(at))
    return data[at], n


class WordTokenizer:
    """texts -> arrays of uint32 ids, equal to the tokenizer's own (add_special_tokens=False).

    Both kinds of vocabulary file split a text before a blank that stands between
    two other characters, and treat what lies between two such cuts alone; so they do
    at a single line's end, and between a letter or digit and the ASCII marks up to the
    cut. So texts are cut there, many at a time, and each different part is looked up
    or encoded once. Parts are remembered: a new one among the young, which are
    forgotten when there are too many in all, and one that comes again for good, as long as
    there is room. New parts are encoded many at a time, with a special token between
    them; where a part is a run of plain letters, the library's model gets it without the
    normalizer and the regular expressions before it. Texts where a blank touches other white space or an end, and texts with
    special strings, are encoded whole.
    """

    #: Words that are remembered for good, at most, and those met once when there are so many; about 200 bytes each.
    MOST, YOUNG = 500_000, 300_000
    #: Words that are encoded as one text.
    TOGETHER = 256
    #: The ASCII marks without the apostrophe, which begins a token of letters.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between = next(iter(added.items()), None)
        setup = json.loads(self.tokenizer.to_str())
        treats = (setup["normalizer"], setup["pre_tokenizer"])
        self.words = treats == WORDS  # blanks are no part of a token, and letters are lower-cased
        self.cuts = self.words or treats == BYTES
        self.plain = PLAIN_WORDS if self.words else PLAIN_BYTES
        # A mark between parts that no part of letters holds.
        mark = "!" + (setup["model"].get("end_of_word_suffix") or "")
        self.mark_id = self.tokenizer.token_to_id(mark) if self.cuts and not setup["model"].get("dropout") else None
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        data = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum())).tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _between(self, tokenizer, parts: list[str], number: int, join: Callable[[list[str]], str]) -> list[bytes]:
        """Ids of parts that are encoded many at a time; join puts what has this number as its id behind each."""
        out: list[bytes] = []
        for k in range(0, len(parts), 16 * self.TOGETHER):
            some = parts[k : k + 16 * self.TOGETHER]
            texts = [join(some[j : j + self.TOGETHER]) for j in range(0, len(some), self.TOGETHER)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == number)
            starts = np.r_[0, ends[:-1] + 1]
            if len(ends) != len(some):
                raise ValueError("a special token stands within a word")
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that hold no special string."""
        plain = [self.mark_id is not None and self.plain.fullmatch(p) is not None for p in parts]
        letters = iter(self._between(self.model, list(compress(parts, plain)), self.mark_id, lambda some: codecs.charmap_decode(("\n!\n".join(some) + "\n!").encode(), "strict", self.letters)[0]))
        other = [p for p, x in zip(parts, plain, strict=True) if not x]
        if self.between is None:
            made = iter(self._encode(other))
        else:
            number, mark = self.between
            made = iter(self._between(self.tokenizer, other, number, lambda some: mark.join(some) + mark))
        return [next(letters if x else made) for x in plain]

    def _look_up(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, remembered or encoded."""
        known, young = self.known, self.young
        out = list(map(known.get, parts))
        new = []
        for k in [k for k, x in enumerate(out) if x is None]:
            ids = out[k] = young.get(parts[k])
            if ids is None:
                new.append(k)
            elif len(known) < self.MOST:
                known[parts[k]] = young.pop(parts[k])
        made = [parts[k] for k in new]
        for k, ids in zip(new, ids_of := self._parts(made), strict=True):
            out[k] = ids
        if len(known) + len(young) + len(made) > self.MOST + self.YOUNG:
            young.clear()
        young.update(zip(made, ids_of, strict=True))
        return out

    def _table(self, words: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow a blank (or, where they begin with \n, a line's end) and of those that begin a text, and how many each has."""
        line = pc.starts_with(words, "\n")
        body = pa.concat_arrays([pc.utf8_ltrim(words, characters="\n"), heads])
        stem = pc.utf8_rtrim(body, characters=self.MARKS)
        stem = pc.if_else(pc.match_substring_regex(stem, BEFORE_MARKS), stem, body)
        marked = np.flatnonzero(pc.not_equal(stem, body).to_numpy(zero_copy_only=False))
        at = pa.array(marked)
        marks = pa.array([b[len(s) :] for b, s in zip(strings(body.take(at)), strings(stem.take(at)), strict=True)], pa.large_string()).dictionary_encode()
        if self.words:
            stem = pc.if_else(pc.string_is_ascii(stem), pc.ascii_lower(stem), stem)
        else:
            blank = pa.concat_arrays([pc.if_else(line, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), pa.array([""] * len(heads), pa.large_string())])
            stem = pc.binary_join_element_wise(blank, stem, pa.scalar("", pa.large_string()))
        stem = stem.dictionary_encode()
        ids = [*self._look_up(strings(stem.dictionary)), *self._look_up(strings(marks.dictionary)), *([b""] if self.words else self._encode(["\n"])), b""]
        # Three units a word: the line's end, the stem, the marks; the last one is none.
        units = np.full((len(body), 3), len(ids) - 1)
        units[: len(words), 0] -= line.to_numpy(zero_copy_only=False)
        units[:, 1] = stem.indices.to_numpy()
        units[marked, 2] = marks.indices.to_numpy() + len(stem.dictionary)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        data, sizes = gather(np.frombuffer(b"".join(ids), dtype=np.uint32), sizes, units.ravel())
        return data, sizes.reshape(-1, 3).sum(axis=1)

    def _whole(self, t: str) -> bool:
        return not self.cuts or t[:1] == " " or t[-1:] == " " or " \n" in t or "\n " in t or any(s in t for s in self.special)

    def flat(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; end_id follows each text."""
        if not texts:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        cut = ~np.fromiter(map(self._whole, texts), dtype=bool, count=len(texts))
        # Single line ends are cut like blanks, and stay at the head of the word behind.
        lines = [t.replace("\n", " \n") if "\n" in t and "\n\n" not in t and t[0] != "\n" and t[-1] != "\n" else t for t, c in zip(texts, cut, strict=True) if c]
        parts = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        ends = parts.offsets.to_numpy()[1:].astype(np.int64)
        number = np.diff(ends, prepend=0)
        words = parts.values.dictionary_encode()
        units, words = words.indices.to_numpy().astype(np.int64), words.dictionary
        begins, stops = (pc.match_substring_regex(words, x).to_numpy(zero_copy_only=False)[units] for x in (LOOSE_BEGIN, LOOSE_END))
        begins[ends - number] = False
        stops[ends - 1] = False
        if (begins | stops).any():
            loose = np.add.reduceat(begins | stops, ends - number, dtype=np.int64) > 0
            units = units[~np.repeat(loose, number)]
            cut[np.flatnonzero(cut)[loose]] = False
            number = number[~loose]
        heads = pa.array([], pa.large_string())
        if not self.words:
            first = np.cumsum(number) - number
            found = words.take(pa.array(units[first])).dictionary_encode()
            heads = found.dictionary
            units[first] = found.indices.to_numpy() + len(words)
        data, sizes = self._table(words, heads)
        whole = self._encode([texts[k] for k in np.flatnonzero(~cut)])
        last = b"" if end_id is None else np.uint32(end_id).tobytes()
        data = np.concatenate([data, np.frombuffer(b"".join([*whole, last]), dtype=np.uint32)])
        each = np.ones(len(texts), dtype=np.int64)
        each[cut] = number
        line = np.empty(int(each.sum()), dtype=np.int64)
        of_cut = np.repeat(cut, each)
        line[of_cut] = units
        line[~of_cut] = len(sizes) + np.arange(len(whole))
        sizes = np.concatenate([sizes, np.fromiter((len(x) // 4 for x in [*whole, last]), dtype=np.int64, count=len(whole) + 1)])
        line = np.insert(line, np.cumsum(each), len(sizes) - 1)
        ids, sizes = gather(data, sizes, line)
        return ids, np.add.reduceat(sizes, np.cumsum(each + 1) - each - 1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids, sizes = self.flat(texts)
        ends = np.cumsum(sizes).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and path, so that what a task has learned serves the next."""
    return WordTokenizer(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
