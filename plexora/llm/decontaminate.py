"""Marks the words of documents that lie in passages of benchmark items, by winnowing.

k-grams of words are hashed, and of each window of w consecutive hashes the
smallest is kept (the last of equal ones). Two texts that share k + w - 1
consecutive words keep the same k-gram there, so matching kept k-grams finds every
shared span of that length; with k = 5 and w = 6 that is 10 words. Each match is
extended word by word to either side, and spans of 10 words or more are hits.
An item of fewer than 10 words is one window of its own length.

A list of fingerprints under a size bound is broadcast, and documents are done in
one pass without a shuffle. Beyond the bound, document fingerprints are joined
with the benchmark's, and only pairs that share one are compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import BROADCAST_BYTES, HashCache, column_of, doc_text, keyed, mix64, rows_where, rows_without, slices, stored, texts_of

#: Words of a window, of a fingerprinted k-gram, and hashes a winnowing window has.
SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: A word is a run of ASCII digits, ASCII letters and characters beyond ASCII; A-Z are lower-cased first.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """UTF-8 bytes of the words; every byte of a character beyond ASCII is 0x80 or more."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def kgrams(ids: np.ndarray, k: int) -> np.ndarray:
    m = len(ids) - k + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + m]
        out ^= out >> np.uint64(31)
    return mix64(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the kept hashes; fewer hashes than a window count as one window."""
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.int64)
    window = min(window, n)
    m = n - window + 1
    best, at = hashes[:m].copy(), np.arange(m)
    for j in range(1, window):
        h = hashes[j : j + m]
        take = h <= best
        best[take] = h[take]
        at[take] = np.arange(j, j + m)[take]
    return np.unique(at)


class Passages:
    """The benchmark's words and fingerprints: what hits are looked up in."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.ids = [i for i, _ in items]
        hash_of = HashCache()
        parts = [np.fromiter(map(hash_of.__getitem__, words_of(t)), dtype=np.uint64) for _, t in items]
        gap = np.zeros(SPAN, dtype=np.uint64)  # keeps items apart
        self.flat = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
        starts, at = [], len(gap)
        for p in parts:
            starts.append(at)
            at += len(p) + len(gap)
        fps, where, owner = [], [], []
        short: dict[int, tuple[list[int], list[int]]] = {}
        for k, p in enumerate(parts):
            if len(p) >= SPAN:
                h = kgrams(p, K)
                kept = winnow(h, WINDOW)
                fps.append(h[kept])
                where.append(kept + starts[k])
                owner.append(np.full(len(kept), k))
            elif len(p):
                hs, owners = short.setdefault(len(p), ([], []))
                hs.append(int(kgrams(p, len(p))[0]))
                owners.append(k)
        empty = np.empty(0, dtype=np.int64)
        fp = np.concatenate([np.empty(0, np.uint64), *fps])
        order = np.argsort(fp, kind="stable")
        self.fp, self.where, self.owner = fp[order], np.concatenate([empty, *where])[order], np.concatenate([empty, *owner])[order]
        self.short = {}
        for n, (hs, owners) in short.items():
            h = np.array(hs, dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            self.short[n] = (h[order], np.array(owners)[order])

    def nbytes(self) -> int:
        return self.flat.nbytes + self.fp.nbytes * 3

    @staticmethod
    def _pairs(sorted_h: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (into h, into sorted_h) of equal values."""
        lo, hi = np.searchsorted(sorted_h, h), np.searchsorted(sorted_h, h, side="right")
        k = hi - lo
        left = np.repeat(np.arange(len(h)), k)
        return left, np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans (start, end, item) of flat that lie in occurrences of windows; flat begins and ends with SPAN zeros."""
        none = np.empty(0, dtype=np.int64)
        starts, ends, owners = [none], [none], [none]
        if len(self.fp):
            h = kgrams(flat, K)
            at = winnow(h, WINDOW)
            at = at[np.isin(h[at], self.fp)]
            d, b = self._pairs(self.fp, h[at])
            d, o, b = at[d], self.owner[b], self.where[b]
            left, right = np.zeros(len(d), dtype=np.int64), np.zeros(len(d), dtype=np.int64)
            for side, sign, edge in ((left, -1, 0), (right, 1, K - 1)):
                open_ = np.arange(len(d))
                for step in range(1, SPAN - K + 1):
                    x, y = flat[d[open_] + edge + sign * step], self.flat[b[open_] + edge + sign * step]
                    open_ = open_[(x == y) & (x != 0)]
                    side[open_] = step
            same = np.ones(len(d), dtype=bool)
            for j in range(K):  # equal hashes are taken for equal words only when they are
                same &= flat[d + j] == self.flat[b + j]
            ok = same & (left + K + right >= SPAN)
            starts.append(d[ok] - left[ok])
            ends.append(d[ok] + K + right[ok])
            owners.append(o[ok])
        for n, (h, own) in self.short.items():
            g = kgrams(flat, n)
            at = np.flatnonzero(np.isin(g, h))
            d, b = self._pairs(h, g[at])
            starts.append(at[d])
            ends.append(at[d] + n)
            owners.append(own[b])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(owners)


NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"


def _packed(texts: list[str], hash_of: HashCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' word hashes in one array with SPAN zeros between, and each text's bounds there."""
    parts = [words_of(t) for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(np.r_[0, counts[:-1]] + SPAN) if len(counts) else counts
    flat = np.zeros(int(counts.sum()) + SPAN * (len(parts) + 1), dtype=np.uint64)
    get = hash_of.__getitem__
    words = np.fromiter((h for p in parts for h in map(get, p)), dtype=np.uint64, count=int(counts.sum()))
    flat[np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(len(words))] = words
    return flat, starts, starts + counts


def _covered(spans: list[tuple[int, int]]) -> int:
    total, last = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _judged(passages: Passages, texts: list[str], hash_of: HashCache) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words, words in hits, and items of each text."""
    flat, starts, ends = _packed(texts, hash_of)
    a, b, o = passages.hits(flat)
    doc = np.searchsorted(starts, a, side="right") - 1
    found: dict[int, list[int]] = {}
    for k, d in enumerate(doc.tolist()):
        found.setdefault(d, []).append(k)
    n_hit, items = np.zeros(len(texts), dtype=np.int64), [[] for _ in texts]
    for d, ks in found.items():
        n_hit[d] = _covered([(int(a[k]), int(b[k])) for k in ks])
        items[d] = sorted({str(passages.ids[o[k]]) for k in ks})
    return ends - starts, n_hit, items


def _one_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, hash_of = shared.value, HashCache()
        for whole in batches:
            for batch in slices(whole):
                n_words, n_hit, items = _judged(passages, texts_of(batch), hash_of)
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(list(map(items_digest, items))), pa.array(n_hit > 0)], NAMES
                )

    return run


def _fingerprints(short: list[int]):
    """(key, row, fp) of texts: winnowed k-grams, and every n-gram of the lengths of short items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = HashCache()
        for whole in batches:
            for batch in slices(whole):
                fps, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for k, t in enumerate(texts_of(batch)):
                    ids = np.fromiter(map(hash_of.__getitem__, words_of(t)), dtype=np.uint64)
                    h = kgrams(ids, K)
                    own = np.unique(np.concatenate([h[winnow(h, WINDOW)] if len(ids) >= SPAN else np.empty(0, np.uint64), *(kgrams(ids, n) + np.uint64(n) for n in short)]))
                    fps.append(own)
                    at.append(np.full(len(own), k))
                yield pa.RecordBatch.from_arrays([column_of(batch, "key").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(fps).view(np.int64))], ["key", "fp"])

    return run


def _item_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hash_of = HashCache()
    for batch in batches:
        keys, fps, sizes = [], [], []
        for key, t in zip(column_of(batch, "key").to_pylist(), texts_of(batch), strict=True):
            ids = np.fromiter(map(hash_of.__getitem__, words_of(t)), dtype=np.uint64)
            h = kgrams(ids, K)
            own = np.unique(h[winnow(h, WINDOW)]) if len(ids) >= SPAN else kgrams(ids, len(ids)) + np.uint64(len(ids)) if len(ids) else np.empty(0, np.uint64)
            keys += [key] * len(own)
            fps.append(own)
            sizes += [len(ids)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate([np.empty(0, np.uint64), *fps]).view(np.int64)), pa.array(sizes, pa.int64())], ["item", "fp", "size"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair (key, text, item, item_text) the spans of hit words as flat bounds."""
    hash_of = HashCache()
    for whole in batches:
        for batch in slices(whole, 4 << 20):
            keys, items, spans = [], [], []
            for key, t, item, it in zip(*(column_of(batch, c).to_pylist() for c in ("key", "text", "item", "item_text")), strict=True):
                flat, starts, _ = _packed([t], hash_of)
                a, b, _o = Passages([(item, it)]).hits(flat)
                if len(a):
                    keys.append(key)
                    items.append(item)
                    spans.append(np.unique(np.column_stack([a, b]), axis=0).ravel() - int(starts[0]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(items, pa.string()), pa.array([s.tolist() for s in spans], pa.list_(pa.int64()))], ["key", "item", "spans"])


def _summed(table: pa.Table) -> pa.Table:
    spans = [x for s in table.column("spans").to_pylist() for x in zip(s[::2], s[1::2], strict=True)]
    items = sorted(set(table.column("item").to_pylist()))
    return pa.table({"key": pa.array(table.column("key").to_pylist()[:1], pa.string()), "n_hit": pa.array([_covered(spans)], pa.int64()), "items": pa.array([items], pa.list_(pa.string()))})


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "key"), pa.array([len(words_of(t)) for t in texts_of(batch)], pa.int64())], ["doc_id", "key", "n_words"])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The way without a broadcast: equal texts are compared once, under the hash of the text as key."""
    keyed = docs.withColumn("key", F.sha2(F.col("text"), 256))
    marked = stored(items.select(F.col("item_id").alias("key"), "text").mapInArrow(_item_fingerprints, "item string, fp long, size long"), "item_fps")
    short = [r["size"] for r in marked.where(F.col("size") < SPAN).select("size").distinct().collect()]  # at most SPAN - 1 rows
    fps = keyed.select("key", "text").mapInArrow(_fingerprints(sorted(short)), "key string, fp long")
    pairs = stored(fps.join(marked.select("item", "fp").distinct(), "fp").select("key", "item").distinct(), "pairs")
    texts = keyed.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = pairs.join(texts, "key").join(items.select(F.col("item_id").alias("item"), F.col("text").alias("item_text")), "item")
    found = both.select("key", "text", "item", "item_text").mapInArrow(_compared, "key string, item string, spans array<long>")
    found = found.groupBy("key").applyInArrow(_summed, "key string, n_hit long, items array<string>")  # a text's hits, at most a row per item
    counts = keyed.select("doc_id", "key", "text").mapInArrow(_word_counts, "doc_id long, key string, n_words long")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counts.join(found, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), F.sha2(F.array_join(F.array_sort(items_of), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words in hits), n_items, items, items_sha256, contaminated of every row.

    Null and empty texts have no words and no hits, and items without words occur
    nowhere. Items with equal texts each count. Equal documents are rows each;
    other columns are ignored. Rows of the benchmark with a null id are left out.
    """
    docs, items = doc_text(docs), _items(benchmark)
    passages = _passages(items, broadcast_bytes)
    if passages is None:
        return _joined(docs, items)
    return docs.mapInArrow(_one_pass(docs.sparkSession.sparkContext.broadcast(passages)), SCHEMA)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _passages(items: DataFrame, broadcast_bytes: int) -> Passages | None:
    """The items' words and fingerprints, where they fit the bound."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    return None if size > broadcast_bytes else Passages([(r["item_id"], r["text"]) for r in items.distinct().orderBy("item_id", "text").collect()])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, whole, that hold no window of a benchmark item; rows with equal or null ids are judged each."""
    items = _items(benchmark)
    passages = _passages(items, broadcast_bytes)
    if passages is None:
        rows = keyed(docs)
        found = _joined(doc_text(rows.withColumn("doc_id", F.col("_row"))), items)
        return rows_without(rows, found.where("contaminated").select("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(passages)

    def judge():  # noqa: ANN202
        hash_of = HashCache()
        return lambda texts: _judged(shared.value, texts, hash_of)[1] == 0

    return rows_where(docs, judge)
