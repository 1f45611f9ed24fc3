"""Toxicity scores: a learned lexicon, Levenshtein automata for misspelled terms, context windows for quotation.

The lexicon is learned from labelled rows: whole words and word beginnings whose
document frequency is far higher in toxic than in clean texts, with a lower bound
of the log ratio as weight. The automaton is the product of the lexicon trie with the Levenshtein
automata of its terms; its deterministic states are made as words need them, so a
word costs one lookup per letter. Hits inside quotation marks or after a word of
reporting count apart, so that quoting a term weighs less than using it. A
logistic model over the few hit features, fitted on rows that the lexicon was
not learned from, gives the score. Labelled texts hardly misspell or quote terms, so
each toxic one of these rows is also given with its terms misspelled, as a toxic
text, and with its terms quoted, as a clean one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import column_of, doc_text, labelled_sample, rows_where, slices, stored, texts_of
from plexora.llm.ngram_join import Shingler

#: Bounds of what is learned: sampled rows per label value, lexicon entries.
PER_CLASS, MOST_ENTRIES = 6000, 6000
#: Fewest toxic texts with an entry, and the least log ratio that is left when either count is moved by 1.5 deviations to its worse side.
LEAST_TEXTS, LEAST_WEIGHT = 5, 2.0
#: Lengths of word beginnings.
STEMS = range(3, 11)
#: Words around a hit that count as its context.
WINDOW = 6
#: Letters that symbols and digits stand for.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Quotation marks, and words of reporting in four languages.
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says quote quoted wrote called word term dit cite mot sagte zitat wort dijo cita palabra".split())
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: str) -> str:
    """Lower case, without marks at either end."""
    return EDGES.sub("", word.lower())


def unmasked(word: str) -> str:
    """plain, with lookalikes read as letters and marks within the word left out; empty where that changes nothing."""
    w = word.lower()
    out = "".join(filter(str.isalpha, w.strip(".,;:!?\"'()").translate(LOOKALIKES)))
    return out if out != plain(word) and sum(map(str.isalpha, w)) >= 2 else ""


class TrieAutomaton:
    """Finds lexicon terms within a number of edits of a word.

    A state is a set of (trie node, edits so far); reading a letter moves it by
    match, substitution, insertion or deletion. States and moves are kept as they
    appear, up to a bound of their (node, edits) pairs.
    """

    MOST_PAIRS = 500_000

    def __init__(self, terms: dict[str, float]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, int] | None] = [None]
        for t in terms:
            node = 0
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                node = self.next[node][c]
            self.term[node] = (t, allowed_edits(t))
        self.most = max((allowed_edits(t) for t in terms), default=0)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.pairs = 0
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        todo = list(state)
        while todo:
            node, e = todo.pop()
            if e < self.most:
                for child in self.next[node].values():
                    if (child, e + 1) not in state:
                        state.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in state:
            best[node] = min(e, best.get(node, e))
        return frozenset(best.items())

    def _state(self, s: frozenset) -> int:
        if s not in self.ids:
            self.ids[s] = len(self.states)
            self.states.append(s)
            self.pairs += len(s)
            self.moves.append({})
        return self.ids[s]

    def _move(self, at: int, c: str) -> int:
        new: set[tuple[int, int]] = set()
        for node, e in self.states[at]:
            for letter, child in self.next[node].items():
                if letter == c:
                    new.add((child, e))
                elif e < self.most:
                    new.add((child, e + 1))
            if e < self.most:
                new.add((node, e + 1))
        to = self._state(self._closed(new)) if new else -1
        self.moves[at][c] = to
        return to

    def find(self, word: str) -> list[tuple[str, int]]:
        """(term, edits) of the terms within their allowed edits, nearest first."""
        if self.pairs > self.MOST_PAIRS:
            self._reset()
        at = self.start
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if at < 0:
                return []
        found = [(self.term[n][0], e) for n, e in self.states[at] if self.term[n] and e <= self.term[n][1]]
        return sorted(found, key=lambda x: (x[1], x[0]))


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class ToxicityModel:
    words: dict[str, float]  # whole words
    stems: dict[str, float]  # beginnings of longer words
    clean: frozenset[str] = frozenset()  # words near a term that clean texts use
    center: list[float] = field(default_factory=lambda: [0.0] * 7)
    scale: list[float] = field(default_factory=lambda: [1.0] * 7)
    weights: list[float] = field(default_factory=lambda: [0.0] * 7)
    bias: float = -3.0

    def terms(self) -> dict[str, float]:
        """All whole words, which are looked for with edits."""
        return dict(sorted(self.words.items()))


class Matcher:
    """Words -> (weight, fuzzy); answers are kept up to a bound."""

    MOST = 300_000

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.terms = model, model.terms()
        self.automaton = TrieAutomaton({w: x for w, x in self.terms.items() if allowed_edits(w)})  # of the others only exact forms count
        self.hits: list[tuple[str, float, bool]] = [("", 0.0, False)]
        self.cache: dict[str, int] = {}

    def exact(self, w: str) -> float:
        weights = [self.model.words.get(w, 0.0)]
        weights += [self.model.stems.get(w[:k], 0.0) for k in STEMS if k < len(w)]
        return max(weights)

    def match(self, word: str) -> tuple[str, float, bool]:
        w = plain(word)
        if not w:
            return ("", 0.0, False)
        if (x := self.exact(w)) > 0:
            return (w, x, False)
        for form in (w, unmasked(word)):
            if len(form) >= 3 and form not in self.model.clean:
                if form != w and form in self.terms:
                    return (form, self.terms[form], True)
                for term, _ in self.automaton.find(form) if len(form) >= 4 else ():
                    return (term, self.terms[term], True)
        return ("", 0.0, False)

    def __call__(self, words: list[str]) -> list[tuple[int, str, float, bool]]:
        """(position, term, weight, fuzzy) of each hit."""
        if len(self.cache) > self.MOST:
            self.cache.clear()
            del self.hits[1:]
        out = []
        for k, word in enumerate(words):
            h = self.cache.get(word)
            if h is None:
                found = self.match(word)
                h = 0
                if found[1] > 0:
                    h = len(self.hits)
                    self.hits.append(found)
                self.cache[word] = h
            if h:
                out.append((k, *self.hits[h]))
        return out


def quoted(words: list[str], k: int) -> bool:
    """Whether the word stands between quotation marks: one is open before it and one follows, or one stands before it after a word of reporting."""
    before, after = words[max(0, k - WINDOW) : k], words[k + 1 : k + 1 + WINDOW]
    opened = sum(w.count(q) for w in before for q in QUOTES) + sum(q in words[k][:1] for q in QUOTES)
    closed = sum(w.count(q) for w in after for q in QUOTES) + sum(q in words[k][-2:] for q in QUOTES)
    return opened % 2 == 1 and closed > 0 or any(plain(w) in REPORTING for w in before[-3:]) and opened > 0


def features(words: list[str], hits: list[tuple[int, str, float, bool]]) -> list[float]:
    """Largest weight, sums and numbers of different terms: used, quoted, misspelled."""
    used: dict[str, float] = {}
    fuzzy: dict[str, float] = {}
    cited: dict[str, float] = {}
    for k, term, weight, near in hits:
        into = cited if quoted(words, k) else fuzzy if near else used
        into[term] = weight
    direct = sorted(used.values(), reverse=True)
    return [
        direct[0] if direct else 0.0,
        direct[1] if len(direct) > 1 else 0.0,
        np.log1p(sum(direct)),
        np.log1p(sum(direct) / np.sqrt(max(len(words), 1)) * 10),
        max(fuzzy.values(), default=0.0),
        np.log1p(sum(fuzzy.values())),
        np.log1p(sum(cited.values())),
    ]


def _entries(text: str) -> tuple[set[str], set[str]]:
    words = {w for w in map(plain, text.split()) if len(w) >= 3}
    return words, {w[:k] for w in words for k in STEMS if k < len(w)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        counts: Counter[tuple[str, bool, int]] = Counter()
        for batch in slices(whole):
            for text, y in zip(texts_of(batch), column_of(batch, "y").to_pylist(), strict=True):
                words, stems = _entries(text)
                counts.update((w, False, y) for w in words)
                counts.update((w, True, y) for w in stems)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k] if k[2] else 0 for k in keys], pa.int64()), pa.array([0 if k[2] else counts[k] for k in keys], pa.int64())], ["entry", "stem", "pos", "neg"]
        )


def learn_lexicon(sample: DataFrame) -> ToxicityModel:
    """Counts entries over the sampled rows(text, y); only the best entries come to the driver."""
    sizes = {r["y"]: r["k"] for r in sample.groupBy("y").agg(F.count("*").alias("k")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = sample.select("text", "y").mapInArrow(_count, "entry string, stem boolean, pos long, neg long").groupBy("entry", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sure = F.log((F.col("pos") - 1.5 * F.sqrt("pos")) / max(n1, 1)) - F.log((F.col("neg") + 1.5 * F.sqrt("neg") + 1.5) / max(n0, 1))
    best = counts.where(F.col("pos") >= LEAST_TEXTS).withColumn("weight", sure).where(F.col("weight") >= LEAST_WEIGHT)
    rows = best.orderBy((F.col("pos") * F.col("weight")).desc(), "entry", "stem").limit(MOST_ENTRIES).collect()
    return ToxicityModel({r["entry"]: r["weight"] for r in rows if not r["stem"]}, {r["entry"]: r["weight"] for r in rows if r["stem"]})


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(4)
    for whole in batches:
        for batch in slices(whole):
            bags = [int(x[0].view(np.int64)) if len(x) else 0 for x in shingler(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in ("doc_id", "text", "y")), pa.array(bags, pa.int64())], ["doc_id", "text", "y", "bag"])


def distinct_texts(sample: DataFrame) -> DataFrame:
    """One row per label value and smallest shingle hash: of a group of copies or near copies about one counts, so that its words don't look like terms."""
    rows = sample.select("doc_id", "text", "y").mapInArrow(_bags, "doc_id long, text string, y int, bag long")
    return stored(rows.groupBy("bag", "y").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text")).drop("bag"), "distinct")


def misspelled(word: str) -> str:
    """The second letter replaced, the same way each time, so that no word beginning of the lexicon is left."""
    return word[:1] + ("q" if word[1:2] != "q" else "x") + word[2:]


def changed(words: list[str], hits: list[tuple[int, str, float, bool]], model: ToxicityModel) -> tuple[list[str], list[str]]:
    """The text with its terms misspelled, as far as they are searched with edits, and with its terms quoted."""
    other, cited = list(words), list(words)
    for k, term, _, _ in hits:
        if term in model.words and allowed_edits(term):
            other[k] = misspelled(term)
        cited[k] = f'said "{words[k]}"'
    return other, " ".join(cited).split()


def _described(model, more: bool = False):
    """Per text its features and the words taken for misspelled terms; with more, also rows for toxic texts with terms misspelled (label 1) and quoted (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.value)
        for whole in batches:
            for batch in slices(whole):
                label, out, near = [], [], []

                def add(y: int, words: list[str]) -> list[tuple[int, str, float, bool]]:
                    hits = matcher(words)
                    label.append(y)
                    out.append(features(words, hits))
                    near.append(sorted({plain(words[k]) for k, _, _, fuzzy in hits if fuzzy}))
                    return hits

                for t, y in zip(texts_of(batch), column_of(batch, "y").to_pylist(), strict=True):
                    words = t.split()
                    hits = add(y, words)
                    if more and y == 1 and hits:
                        other, cited = changed(words, hits, model.value)
                        if other != words:
                            add(1, other)
                        add(0, cited)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(out, pa.list_(pa.float64())), pa.array(near, pa.list_(pa.string()))], ["y", "x", "near"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Learns from at most per_class training rows of each label value: three of four for the lexicon, the others for the score."""
    spark = docs.sparkSession
    sample = distinct_texts(labelled_sample(docs, labels, label, per_class))
    rest = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0
    model = learn_lexicon(sample.where(~rest))
    described = "y int, x array<double>, near array<string>"

    def clean_words(rows: DataFrame) -> frozenset[str]:
        """Words of clean texts that lie near a term: they are no misspellings. The sample bounds them."""
        near = rows.where("y = 0").select("text", "y").mapInArrow(_described(spark.sparkContext.broadcast(model)), described)
        return frozenset(r["w"] for r in near.select(F.explode("near").alias("w")).distinct().collect())

    model.clean = clean_words(sample.where(~rest))
    rows = sample.where(rest).select("text", "y").mapInArrow(_described(spark.sparkContext.broadcast(model), more=True), described).select("y", "x").toPandas()
    if rows["y"].nunique() < 2:
        return model
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy(dtype=float)
    center, scale = x.mean(0), np.maximum(x.std(0), 0.05)
    w, b = logistic((x - center) / scale, y)
    w[:6] = np.maximum(w[:6], 0)  # a term, misspelled or not, is never a sign of a clean text,
    w[6] = min(w[6], 0)  # and a quoted one never of a toxic one
    model.center, model.scale, model.weights, model.bias = center.tolist(), scale.tolist(), w.tolist(), b
    model.clean |= clean_words(sample.where(rest))  # only now, so that the weights were learned with words unseen
    return model


class Scorer:
    """texts -> (scores, the different terms met in each)."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.matcher = model, Matcher(model)
        self.center, self.scale, self.weights = map(np.array, (model.center, model.scale, model.weights))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[list[str]]]:
        z, terms = np.empty(len(texts)), []
        for k, t in enumerate(texts):
            words = t.split()
            hits = self.matcher(words)
            z[k] = float((np.array(features(words, hits)) - self.center) / self.scale @ self.weights) + self.model.bias
            terms.append(sorted({h[1] for h in hits}))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), terms


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole):
                score, terms = scorer(texts_of(batch))
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(score, pa.float64()), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "score", "terms"])

    return run


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, whole, that score below the threshold. One pass; rows with equal or null ids are judged each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_ENTRIES entries

    def judge():  # noqa: ANN202
        scorer = Scorer(shared.value)
        return lambda texts: scorer(texts)[0] < threshold

    return rows_where(docs, judge)


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, terms) of every row: the score in 0..1 and the different lexicon terms that were met.

    Null and empty texts have the score of a text without hits; texts are read whole,
    however long they are; equal rows and rows with a null id are scored each; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_ENTRIES entries
    return doc_text(docs).mapInArrow(_scored(shared), "doc_id long, score double, terms array<string>")
