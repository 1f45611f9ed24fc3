"""License notices by conditional compression.

Every template is looked for in a block (a paragraph of lines, without comment marks,
that speaks of licensing). The window round its words is compressed alone and with the
template as a raw zstandard dictionary, both as lower-case words without marks between;
the template must save a share of its own compressed size, so that words strewn over a
long text are no notice, and what stands between the words but other words changes
nothing. Within that, the wording is exact: no word may be missing or changed (a share
of them for long ones), the words that identify it (names, versions) must be there, in
order and within a sentence. Of a block every notice is reported whose words are not all part of a longer
one. A candidate line outside all notices is compressed with each template, and the
one that saves most is the nearest.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from plexora.llm.common import column_of, doc_text, slices, texts_of

#: Notices, by license id.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: What may stand between two words of a term: spaces, or a line's end with comment marks.
GAP = r"(?:\s+|[^\w\n]*\n[\W_]*(?:(?:dnl|rem)\b[\W_]*)?)"
#: Words that make a line a candidate.
TRIGGER = re.compile(rf"\b(?:licen[cs]e[ds]?|copyright|rights{GAP}reserved|permission|redistribution|public{GAP}domain|cc0|creative{GAP}commons|spdx)\b", re.IGNORECASE)
#: Comment marks at a line's beginning and end.
MARKS = re.compile(r"^[^\w\"'“(\[]*(?:(?:dnl|rem)\b[^\w\"'“(\[]*)?|\s+[*#/|;%<>!-]+$|\*+/$", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+(?:(?:[.\-]|-\n)[^\W_]+)*")
#: A notice's window saves at least this share of the template's own compressed size, or what a shorter template saves on itself; this share of a template's words may differ.
LEAST_SAVED, MOST_MISSING = 0.15, 0.05
#: What stands between two words where a sentence ends.
SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s+\W*$")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class LicenseScanner:
    """Blocks -> their notices, and the nearest templates of other candidate lines; answers for short blocks are kept up to a bound."""

    MOST = 20_000

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {k: words_of(t) for k, t in templates.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=3)
        own = {k: " ".join(w).encode("utf-8", "surrogatepass") for k, w in self.words.items()}
        self.given = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in own.items()}
        self.sizes = {k: len(self.alone.compress(t)) for k, t in own.items()}
        self.least = {k: min(LEAST_SAVED, self.saved(w, k)) for k, w in self.words.items()}
        self.cache: dict[str, tuple[int, list[tuple[int, str | None, float, list[str]]]]] = {}

    def saved(self, words: list[str], name: str) -> float:
        """Bytes that the template saves on the words, as a share of the template's own compressed size."""
        data = " ".join(words).encode("utf-8", "surrogatepass")
        return (len(self.alone.compress(data)) - len(self.given[name].compress(data))) / self.sizes[name]

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """(saved, template), best first."""
        words = words_of(block)
        return sorted(((self.saved(words, k), k) for k in self.given), key=lambda x: (-x[0], x[1]))

    def differences(self, block: str, name: str) -> list[str]:
        """Words of the template that the block lacks or has otherwise, in order."""
        ours, theirs = self.words[name], words_of(block)
        found = SequenceMatcher(None, ours, theirs, autojunk=False).get_matching_blocks()
        have = {k for m in found for k in range(m.a, m.a + m.size)}
        return [w for k, w in enumerate(ours) if k not in have]

    def whole(self, word: str) -> str:
        """A word that a line's end parts: without the hyphen where templates have it so."""
        if "\n" not in word:
            return word
        bare = word.replace("-\n", "")
        return bare if any(bare in c for c in self.counts.values()) else word.replace("\n", "")

    def possible(self, words: Counter[str]) -> list[str]:
        """Templates of which the words hold enough, whatever their order: no other can be confirmed."""
        out = []
        for name, counts in self.counts.items():
            lacking = {w: n - words[w] for w, n in counts.items() if words[w] < n}
            if sum(lacking.values()) <= MOST_MISSING * len(self.words[name]) and not any(c.isdigit() for w in lacking for c in w):
                out.append(name)
        return out

    def occurrences(self, name: str, words: list[str], first: set[int]) -> list[tuple[tuple[int, ...], list[str]]]:
        """(positions of the template's words, its missing words) of each place that has the template's words in order within a sentence.

        first has the positions where sentences begin. Places don't overlap; those
        with fewer missing words, then the shorter ones, are preferred.
        """
        ours = self.words[name]
        n, most = len(ours), int(MOST_MISSING * len(ours))
        where: dict[str, list[int]] = {}
        for j in reversed(range(n)):
            where.setdefault(ours[j], []).append(j)

        def skipped(a: int, b: int, k: int) -> bool:
            return k + b - a <= most and not any(c.isdigit() for w in ours[a:b] for c in w)

        # at[j][k]: the positions and missing words of the latest start with j words behind, the last one met, k missing.
        at: list[dict[int, tuple[tuple[int, ...], tuple[int, ...]]]] = [{} for _ in range(n + 1)]
        found = []
        for i, w in enumerate(words):
            if i in first:
                at = [{} for _ in range(n + 1)]
            for j in where.get(w, ()):
                for p in range(max(0, j - most), j + 1):
                    for k, (hits, missing) in list(at[p].items()) if p else [(0, ((), ()))]:
                        if skipped(p, j, k):
                            k, own = k + j - p, ((*hits, i), (*missing, *range(p, j)))
                            if k not in at[j + 1] or at[j + 1][k][0][0] <= own[0][0]:
                                at[j + 1][k] = own
                            if skipped(j + 1, n, k):
                                found.append((own[0], (*own[1], *range(j + 1, n))))
        out: list[tuple[tuple[int, ...], list[str]]] = []
        taken: set[int] = set()
        for hits, missing in sorted(found, key=lambda x: (len(x[1]), x[0][-1] - x[0][0], x[0])):
            if hits and taken.isdisjoint(span := range(hits[0], hits[-1] + 1)):
                taken.update(span)
                out.append((hits, [ours[j] for j in missing]))
        return out

    def confirmed(self, block: str) -> list[tuple[tuple[int, ...], str, float, list[str]]]:
        """(positions, template, saved, missing words) of every notice in the block, those with most words first.

        What a template saves is taken from the window round its words, so that
        nothing depends on how much other text the block holds.
        """
        spans = [m.span() for m in WORD.finditer(block)]
        words = [self.whole(block[a:b].lower()) for a, b in spans]
        names = self.possible(Counter(words))
        if not names:
            return []
        first = {i for i in range(1, len(spans)) if block[spans[i][0]].isupper() and SENTENCE_END.fullmatch(block, spans[i - 1][1], spans[i][0])}
        found = []
        for name in names:
            for hits, missing in self.occurrences(name, words, first):
                saved = self.saved(words[hits[0] : hits[-1] + 1], name)
                if saved >= self.least[name]:
                    found.append((hits, name, saved, missing))
        return sorted(found, key=lambda x: (-len(x[0]), len(x[3]), x[1]))

    def notices(self, block: str) -> list[tuple[tuple[int, int], str, float, list[str]]]:
        """(span of characters, template, saved, missing words) of every notice whose words are not all part of a longer one."""
        within: dict[int, set[int]] = {}
        out = []
        for hits, name, saved, missing in self.confirmed(block):
            if not set.intersection(*(within.get(h, set()) for h in hits)):
                for h in hits:
                    within.setdefault(h, set()).add(len(out))
                out.append((hits, name, saved, missing))
        spans = [m.span() for m in WORD.finditer(block)] if out else []
        return [((spans[hits[0]][0], spans[hits[-1]][1]), *rest) for hits, *rest in out]

    def __call__(self, block: str) -> tuple[int, list[tuple[int, str | None, float, list[str]]]]:
        """Number of candidate lines, and (line, template or None, saved, differences) of each notice and of each candidate line outside all notices.

        A notice's line is the one it begins in; lines of a block are parted by line ends.
        """
        if not TRIGGER.search(block):
            return 0, []
        if block in self.cache:
            return self.cache[block]
        ends = [m.start() for m in re.finditer("\n", block)]
        candidates = sorted({bisect_left(ends, m.start()) for m in TRIGGER.finditer(block)})
        found: list[tuple[int, str | None, float, list[str]]] = []
        covered: set[int] = set()
        lines = block.split("\n")
        for (start, stop), name, saved, missing in self.notices(block):
            covered.update(range(bisect_left(ends, start), bisect_left(ends, stop) + 1))
            found.append((bisect_left(ends, start), name, saved, missing))
        for k in candidates:
            if k not in covered:
                saved, name = self.ranked(lines[k])[0]
                found.append((k, None, saved, self.differences(lines[k], name) if saved >= LEAST_SAVED else []))
        out = (len(candidates), sorted(found, key=lambda f: (f[0], f[1] or "")))
        if len(block) < 1000:
            if len(self.cache) >= self.MOST:
                self.cache.clear()
            self.cache[block] = out
        return out


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(number of its first line, lines without comment marks) of each run of lines with text."""
    start, lines = 0, []
    for k, line in enumerate(text.split("\n")):
        if line := MARKS.sub("", line.strip()).strip():
            if not lines:
                start = k
            lines.append(line)
        elif lines:
            yield start, "\n".join(lines)
            lines = []
    if lines:
        yield start, "\n".join(lines)


FINDING = pa.struct([("line", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("differences", pa.list_(pa.string()))])


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates)
        for whole in batches:
            for batch in slices(whole):
                findings, sizes = [], []
                for t in texts_of(batch):
                    own, size = [], 0
                    if TRIGGER.search(t):
                        for start, block in paragraphs(t):
                            n, found = scanner(block)
                            size += n
                            own += [{"line": start + k, "license": name, "saved": saved, "differences": missing} for k, name, saved, missing in found]
                    findings.append(own)
                    sizes.append(size)
                names = [sorted({f["license"] for f in own if f["license"]}) for own in findings]
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([x > 0 and not n for x, n in zip(sizes, names, strict=True)]), pa.array(findings, pa.list_(FINDING))], ["doc_id", "n_candidates", "licenses", "unknown_wording", "findings"]
                )

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_candidates, licenses, unknown_wording, findings (line, license, saved, differences) of every row.

    n_candidates counts the lines in which a term of licensing begins; licenses has
    the confirmed template ids, sorted; unknown_wording marks rows with
    candidate lines of which none is confirmed. Null and empty texts have none;
    equal rows are scanned each; other columns are ignored.
    """
    return doc_text(docs).mapInArrow(_scan(templates or TEMPLATES), "doc_id long, n_candidates long, licenses array<string>, unknown_wording boolean, findings array<struct<line:long,license:string,saved:double,differences:array<string>>>")
