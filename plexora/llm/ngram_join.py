"""Self-join of documents on the Jaccard similarity of word n-gram sets, by token-combination prefixes.

Method. All n-grams get one global order: rare ones first, frequent ones last,
by hash within either. A document of n n-grams that is similar to another can
miss at most tau of them there, so among the first tau + 1 single n-grams at
least one is shared. Where a document's prefix reaches into the frequent class,
single n-grams would make long lists; there the prefix is extended and pairs
(2-combinations) of frequent n-grams are indexed instead. The pairs are formed
within buckets of the class (about n/16 of them, by n-gram hash): with c n-grams
of a bucket in the prefix, c - 1 would have to be missing to lose all its pairs,
so the prefix grows until rare + sum(max(0, c - 1)) exceeds tau. Signatures per
document stay linear in n. The number of buckets depends on the size level
floor(log2 n); two similar documents always have a common level, and a document
near a level's end is indexed at both.

Which n-grams are frequent is counted over all documents. The class only steers
cost, never the result: any fixed choice keeps every link. The broadcast list of
frequent n-grams is therefore kept under a bound by raising its threshold.

n-grams that aren't counted (those beyond the counted share of the hash range) are
treated as frequent ones. Signatures are made per size level, so that classes that
share one are of about one size.

Equal sets are one class from the start (by a 64-bit hash of the set). A list of
classes that share a signature is settled from its centre, its most connected class:
every other class is compared with the centre, which joins most groups of near copies
at once. Of what is still apart, short lists give their pairs. In long ones each class
is described anew by what it has more or less than the centre (its difference), and
the prefixes of these differences are signatures of a second index. Two similar classes
of which one isn't similar to the centre have more than half of the smaller difference
in common, so what the group shares is no signature any more. A list of the second index
is settled in one task, where the differences decide exactly, after filters by their
sizes and by the places in the prefixes: it gives a link for each two components that it
joins, less than one per class, however many pairs are similar.

Candidate pairs are sifted by histograms of their n-grams, which bound the overlap
from above, and those left are verified on whole n-gram sets of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import BROADCAST_BYTES, Bloom, HashCache, bloom, collect_garbage, column_of, discard, doc_text, mix64, plan_bytes, power_of_two, slices, stored, texts_of, unburden
from plexora.llm.graphs import components

#: n-grams whose hash lies in this share of the hash range are counted; a prefix lies there unless over half of a document is frequent.
COUNTED = 0.30
LIMIT = np.uint64(int(COUNTED * 2**64))
#: n-grams in at least this many documents are frequent.
FREQUENT = 24
#: Cells of the histograms by which pairs are sifted before their sets are compared, and of those of differences.
CELLS, COARSE, DIFFERENCE_CELLS = 512, 64, 1024
#: Lists of up to SHORT classes are paired as they are, longer ones by differences. Rows of one key of a join with large values are dealt out in shares of about SHARE.
SHORT, SHARE = 12, 1000
#: Pairs of classes of a list that are looked at together.
BLOCK = 1 << 17
#: n-grams of a size level per bucket of the frequent class.
PER_BUCKET = 16


class Shingler:
    """Texts -> sorted distinct 64-bit hashes of their word n-grams."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, HashCache()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        get = self.words.__getitem__
        flat = np.fromiter((h for p in parts for h in map(get, p)), dtype=np.uint64, count=sum(map(len, parts)))
        grams = self._grams(flat)
        out, at = [], 0
        for p in parts:
            n = len(p)
            if n >= self.width:
                out.append(np.unique(grams[at : at + n - self.width + 1]))
            elif n:
                short = np.array([n], dtype=np.uint64)
                for k in range(at, at + n):
                    short = mix64(short * np.uint64(0x9E3779B97F4A7C15) + flat[k])
                out.append(short)
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += n
        return out

    def _grams(self, flat: np.ndarray) -> np.ndarray:
        m = len(flat) - self.width + 1
        if m <= 0:
            return np.empty(0, dtype=np.uint64)
        out = np.zeros(m, dtype=np.uint64)
        for k in range(self.width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + m]
            out ^= out >> np.uint64(29)
        return mix64(out)


def set_id(grams: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def tau(n: int, percent: int) -> int:
    """The most n-grams of a set of n that a similar set can lack."""
    return n - (percent * n + 99) // 100


def levels(n: int, percent: int) -> set[int]:
    """The size levels of a set: that of its size, and that of the largest similar set."""
    return {n.bit_length() - 1, (100 * n // percent).bit_length() - 1}


def is_hot(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which n-grams are of the frequent class: those known as frequent, and those that aren't counted."""
    hot = grams >= LIMIT
    if len(frequent):
        at = np.searchsorted(frequent, grams)
        at[at == len(frequent)] = 0
        hot |= frequent[at] == grams
    return hot


def signatures(grams: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The distinct signatures under which a set is indexed; see the module's text."""
    n = len(grams)
    need = tau(n, percent) + 1
    hot = is_hot(grams, frequent)
    rare, out = grams[~hot][:need], []
    many = grams[hot]
    for level in levels(n, percent):
        salt = mix64(np.array([level + 1], dtype=np.uint64))
        out.append(mix64(rare ^ salt))
        if len(rare) == need:
            continue
        buckets = (1 << level) // PER_BUCKET
        if not buckets:  # short sets: single n-grams in either class
            out.append(mix64(many[: need - len(rare)] ^ salt))
            continue
        bucket = (many & np.uint64(buckets - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.ones(len(many), dtype=bool)
        first[order[1:]] = bucket[order[1:]] != bucket[order[:-1]]
        gained = np.cumsum(~first) + len(rare)  # a bucket's first n-gram gains nothing
        end = int(np.searchsorted(gained, need)) + 1
        for b in np.unique(bucket[:end]):
            own = many[:end][bucket[:end] == b]
            i, j = np.triu_indices(len(own), 1)
            out.append(mix64(own[i] * np.uint64(0x9E3779B97F4A7C15) + mix64(own[j] ^ salt)))
    return np.unique(np.concatenate(out))


def difference(x: np.ndarray, c: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The difference between a set and its centre, and the lengths of its two prefixes.

    The first prefix meets those of classes of which one at least isn't similar to the
    centre; the second is that of a class that isn't, for partners that are.

    Sizes of differences obey the triangle inequality. Sets x and y with differences
    X and Y to c are similar when X and Y differ in at most t = f(|x| + |y|) n-grams,
    f = (100 - percent) / (100 + percent), so they share o >= (|X| + |Y| - t) / 2 of
    them. If x isn't similar to c, |X| > f(|x| + |c|): then o > (|Y| + f(|c| - |y|)) / 2,
    and o >= |X| - t. A prefix of |Y| - o + 1, in an order that all differences to c
    have, holds a common n-gram. What c lacks goes first, the rare ones before others.
    """
    added, missing = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
    hot = is_hot(added, frequent)
    own = np.concatenate([added[~hot], added[hot], missing])
    n, m, d = len(x), len(c), len(own)
    half = d - (d * (100 + percent) + (100 - percent) * (m - n)) // (2 * (100 + percent))
    return own, min(max(half, 0), d), min(n * (100 - percent) // percent + 1, d)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _bucketed(values: np.ndarray, buckets: int, span: float) -> tuple[list[int], list[bytes], list[bytes]]:
    """Distinct values and their counts, cut by ranges of the hash: numbers of the buckets that have any, values, counts."""
    values, counts = np.unique(values, return_counts=True)
    cuts = np.searchsorted(values, np.array([int(span * 2**64 * b / buckets) for b in range(1, buckets)], dtype=np.uint64))
    v, c = np.split(values, cuts), np.split(counts.astype(np.uint32), cuts)
    full = [b for b in range(buckets) if len(v[b])]
    return full, [v[b].tobytes() for b in full], [c[b].tobytes() for b in full]


def _measure(width: int, buckets: int):
    """Per document its set's size and id; per hash bucket the distinct counted n-grams of some million and how often they came."""
    names = ["doc_id", "key", "n", "nid", "bucket", "grams", "counts"]

    def counted(kept: list[np.ndarray]) -> pa.RecordBatch:
        full, grams, counts = _bucketed(np.concatenate(kept), buckets, COUNTED)
        none = pa.nulls(len(full), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(full, pa.int32()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        shingler, kept, size = Shingler(width), [], 0
        for whole in batches:
            for batch in slices(whole):
                sets = shingler(texts_of(batch))
                kept.append(np.concatenate([np.empty(0, np.uint64), *(s[: np.searchsorted(s, LIMIT)] for s in sets)]))
                size += len(kept[-1])
                rows = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "doc_id"), column_of(batch, "key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())], names
                )
                if size > 2_000_000:
                    yield counted(kept)
                    kept, size = [], 0
        if size:
            yield counted(kept)

    return run


def _counted(least: int):
    def run(table: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("counts").to_pylist()])
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, np.int64)
        total = np.add.reduceat(counts, starts) if len(starts) else np.empty(0, np.int64)
        keep = total >= least
        return pa.table({"gram": _i64(grams[starts][keep]), "df": pa.array(total[keep], pa.int64())})

    return run


def frequent_grams(parts: DataFrame, most: int = BROADCAST_BYTES // 8) -> np.ndarray:
    """The counted n-grams in at least FREQUENT documents, sorted; the threshold doubles until at most ``most`` of them are left.

    Each bucket gets a batch's n-gram once with its count, so that even an n-gram
    of all documents is one entry per batch; buckets are ranges of a hash.
    """
    counts = stored(parts.groupBy("bucket").applyInArrow(_counted(FREQUENT), "gram long, df long"), "frequent")
    by_power = {r["p"]: r["k"] for r in counts.groupBy(F.floor(F.log2(F.col("df") / FREQUENT)).cast("int").alias("p")).agg(F.count("*").alias("k")).collect()}
    power, left = 0, sum(by_power.values())
    while left > most:
        left -= by_power.get(power, 0)
        power += 1
    rows = counts.where(F.col("df") >= FREQUENT * 2**power).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def histogram(grams: np.ndarray, cells: int = CELLS) -> bytes:
    """How many n-grams of a set fall into each cell of their low bits, 255 standing for that and more."""
    counts = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def coarse(cells: bytes) -> bytes:
    """The same with COARSE cells."""
    fine = np.frombuffer(cells, dtype=np.uint8).astype(np.int64)
    full = (fine == 255).reshape(-1, COARSE).any(0)
    return np.where(full, 255, np.minimum(fine.reshape(-1, COARSE).sum(0), 255)).astype(np.uint8).tobytes()


def _index(width: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        shingler, frequent = Shingler(width), shared.value
        seen: set[int] = set()  # copies within a task are indexed once, as far as there is room
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                rows = []
                if len(seen) > 200_000:
                    seen.clear()
                for grams in shingler(texts_of(batch)):
                    if len(grams) and (key := set_id(grams)) not in seen:
                        seen.add(key)
                        rows.append((key, len(grams), signatures(grams, frequent, percent).tobytes(), histogram(grams)))
                if rows:
                    nid, n, sigs, cells = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(nid, pa.int64()), pa.array(n, pa.int32()), pa.array(sigs, pa.binary()), pa.array(cells, pa.binary())], ["nid", "n", "sigs", "cells"])

    return run


def _words(column: pa.Array) -> np.ndarray:
    """The 64-bit words of all values of a binary column, without a copy."""
    if not len(column):
        return np.empty(0, dtype=np.uint64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint64) if offsets[-1] > offsets[0] else np.empty(0, dtype=np.uint64)


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        kept: list[np.ndarray] = []
        names = ["bucket", "grams", "counts"]

        def counted() -> pa.RecordBatch:
            full, sigs, counts = _bucketed(np.concatenate(kept), buckets, 1.0)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sigs, pa.binary()), pa.array(counts, pa.binary())], names)

        for batch in batches:
            kept.append(_words(column_of(batch, "sigs")).copy())
            if sum(map(len, kept)) > 2_000_000:
                yield counted()
        if sum(map(len, kept)):
            yield counted()

    return run


def _posted(shared):
    """(sig, nid, n, coarse, cells): a row per signature that others may have too, and per class with any of them its cells (sig null)."""
    names = ["sig", "nid", "n", "coarse", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        several = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                sigs = column_of(batch, "sigs")
                flat = _words(sigs)
                row = np.repeat(np.arange(len(sigs)), np.array([v.as_buffer().size // 8 for v in sigs]))
                keep = several(flat) if len(flat) else np.zeros(0, dtype=bool)
                row, flat = row[keep], flat[keep]
                some, own = pa.array(np.unique(row)), pa.array(row)
                nid, n, cells = (column_of(batch, c) for c in ("nid", "n", "cells"))
                cells = cells.take(some)
                yield pa.RecordBatch.from_arrays([_i64(flat), nid.take(own), n.take(own), pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.binary())], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), nid.take(some), n.take(some), pa.array([coarse(x) for x in cells.to_pylist()], pa.binary()), cells], names)

    return run


def _can_be_similar(percent: int):
    """Keeps the pairs whose cells allow the similarity: a common n-gram lies in the same cell of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                x, y = (_words(column_of(batch, c)).view(np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
                most = np.minimum(x, y).sum(1, dtype=np.int64)
                fits = 100 * most >= percent * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64) - most)
                keep = fits | (x == 255).any(1) | (y == 255).any(1)  # a full cell says nothing
                yield batch.filter(pa.array(keep)).select([k for k in batch.schema.names if k not in ("x", "y")])

    return run


def _known(shared, name: str):
    """The rows whose column of this name the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value(column_of(batch, name).to_numpy().astype(np.int64))))

    return run


def _sets(width: int, shared):
    """(nid, grams) of the texts whose key the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        shingler, wanted = Shingler(width), shared.value
        for whole in batches:
            for batch in slices(whole.filter(pa.array(wanted(column_of(whole, "key").to_numpy().astype(np.int64)))), 2 << 20):
                sets = [s for s in shingler(texts_of(batch)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["nid", "grams"])

    return run


def _verify(percent: int, shared=None):
    """Per pair (a, b, x, y) the size of the overlap and whether it is enough.

    With shared n-grams and where long, also the size d of a's difference to b and its
    signatures: of a class that isn't similar to b, half of them for partners of its own
    kind, the others for similar ones; the difference itself, sorted, and its histogram.
    """
    names = ["a", "b", "common", "similar"] + ["d", "half", "sigs", "own", "spread"] * (shared is not None)
    salts = mix64(np.array([11, 12], dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, bs = (column_of(batch, c) for c in ("x", "y", "b"))
            long = column_of(batch, "long").to_pylist() if shared is not None else []
            common, ok, rows = [], [], []
            for k in range(batch.num_rows):
                x, y = np.frombuffer(xs[k].as_buffer(), dtype=np.uint64), np.frombuffer(ys[k].as_buffer(), dtype=np.uint64)
                c = len(np.intersect1d(x, y, assume_unique=True))
                common.append(c)
                ok.append(100 * c >= percent * (len(x) + len(y) - c))
                if shared is None:
                    continue
                if not long[k]:
                    rows.append((None,) * 5)
                    continue
                own, half, most = difference(x, y, percent, shared.value)
                keyed = own ^ mix64(np.array([bs[k].as_py()]).view(np.uint64))
                first, second = (keyed[:0], keyed[:half]) if ok[-1] else (keyed[:half], keyed[:most])
                rows.append((len(own), len(first), mix64(np.concatenate([first ^ salts[0], second ^ salts[1]])).view(np.int64), np.sort(own).tobytes(), histogram(own, DIFFERENCE_CELLS)))
            out = [column_of(batch, "a"), bs, pa.array(common, pa.int64()), pa.array(ok, pa.bool_())]
            if shared is not None:
                out += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


class DifferenceList:
    """The classes of one list (nid, c, n, d, at, side, comp) of differences, and which of them sizes and places allow to be similar.

    With spread, the differences' histograms, these have to allow it too.
    """

    def __init__(self, table: pa.Table, percent: int) -> None:
        self.spread = np.stack([np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in table.column("spread")]) if "spread" in table.column_names else None
        self.nid, self.c, self.n, self.d, self.at, self.side = (table.column(k).to_numpy().astype(np.int64) for k in ("nid", "c", "n", "d", "at", "side"))
        self.comp, self.percent = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1], percent

    def fits(self, i, j) -> np.ndarray:
        """Whether sizes and places allow the classes at i and at j, of different components, to be similar."""
        n, d, share, sides = self.n[j], self.d[j], 100 + self.percent, self.side[i] + self.side[j]
        most = (100 - self.percent) * (self.n[i] + n)
        fits = (self.comp[i] != self.comp[j]) & (self.c[i] == self.c[j]) & ((sides == 0) | (sides == 3)) & (100 * np.minimum(self.n[i], n) >= self.percent * np.maximum(self.n[i], n))
        return fits & (share * np.abs(self.d[i] - d) <= most) & (2 * share * np.minimum(self.d[i] - self.at[i], d - self.at[j]) >= share * (self.d[i] + d) - most)

    def after(self, i: int) -> np.ndarray:
        """The classes after i, from other components, that can be similar to it."""
        share, fits = 100 + self.percent, self.fits(i, slice(i + 1, None))
        js = i + 1 + np.flatnonzero(fits)
        if self.spread is None or not len(js):
            return js
        x, y, d = self.spread[i], self.spread[js], self.d[js]
        shared = np.minimum(x, y).sum(1, dtype=np.int64)  # a common n-gram lies in the same cell of both
        fits = 2 * share * shared >= share * (self.d[i] + d) - (100 - self.percent) * (self.n[i] + self.n[js])
        return js[fits | (x == 255).any() | (y == 255).any(1)]  # a full cell says nothing


def _partnered(percent: int):
    """The rows of one list that have any partner in it, so that only their histograms, then their differences, need be moved."""

    def run(table: pa.Table) -> pa.Table:
        found, some = DifferenceList(table, percent), np.zeros(table.num_rows, dtype=bool)
        if found.spread is None:
            step = max(1, BLOCK // max(table.num_rows, 1))
            for k in range(0, table.num_rows, step):
                some[k : k + step] = found.fits(np.arange(k, min(k + step, table.num_rows))[:, None], slice(None)).any(1)
            return table.filter(pa.array(some))
        for i in range(table.num_rows - 1):
            if len(js := found.after(i)):
                some[i] = some[js] = True
        return table.filter(pa.array(some))

    return run


def _joined(percent: int):
    """Links of similar classes of one list with own, the differences: a spanning tree of each component of them.

    Sets x and y with differences X and Y to the same centre differ in just the n-grams
    in which X and Y do, so that the differences decide exactly. A class is compared with
    those that are neither in its component by then nor left out by size or place.
    """

    def run(table: pa.Table) -> pa.Table:
        found = DifferenceList(table, percent)
        own = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table.column("own")]
        n, d, comp, a, b = found.n, found.d, found.comp, [], []
        for i in range(table.num_rows - 1):
            js = found.after(i)
            if not len(js):
                continue
            flat = np.concatenate([own[k] for k in js])
            place = np.searchsorted(own[i], flat)
            place[place == len(own[i])] = 0  # own[i] isn't empty: it has the list's n-gram
            hits = np.r_[0, np.cumsum(own[i][place] == flat)]
            ends = np.cumsum(d[js])
            both, differ = n[i] + n[js], d[i] + d[js] - 2 * (hits[ends] - hits[ends - d[js]])
            similar = js[100 * (both - differ) >= percent * (both + differ)]
            if len(similar):
                comps, first = np.unique(comp[similar], return_index=True)
                a += [found.nid[i]] * len(first)
                b += found.nid[similar[first]].tolist()
                comp[np.isin(comp, comps)] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class NgramJaccard:
    """The join over one table of documents; its steps are stored as they are made, and deleted when they are done with.

    ``width`` words make an n-gram; a text of fewer words is one n-gram, one without
    words has an empty set and no link. Documents link from ``percent`` Jaccard
    similarity. Null texts are empty; texts may be of any length; rows with equal ids
    are rows of their own, and so are rows with a null id, which name no class;
    other columns are ignored.
    """

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80) -> None:
        self.docs = doc_text(docs).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
        self.width, self.percent, self.spark = width, percent, docs.sparkSession
        self.buckets = power_of_two(plan_bytes(self.docs) / (8 << 20), 16, 1 << 14)
        found = stored(self.docs.mapInArrow(_measure(width, self.buckets), "doc_id long, key long, n long, nid long, bucket int, grams binary, counts binary"), "measured")
        self.rows = stored(found.where("bucket is null").select("doc_id", "key", "n", "nid"), "rows")
        self.frequent = self.spark.sparkContext.broadcast(frequent_grams(found.where("bucket is not null").select("bucket", "grams", "counts")))
        discard(found)
        self._post()

    def _post(self) -> None:
        """postings: (sig, nid, n) of signatures that came twice or may have; cells: (nid, coarse, cells) of their classes.

        Signatures are counted like n-grams, and a filter of those that came twice
        leaves out most others; what it lets pass in vain is a list of one class.
        """
        index = stored(self.docs.select("text").mapInArrow(_index(self.width, self.percent, self.frequent), "nid long, n int, sigs binary, cells binary"), "index")
        parts = index.select("sigs").mapInArrow(_cut(self.buckets), "bucket int, grams binary, counts binary")
        several = stored(parts.groupBy("bucket").applyInArrow(_counted(2), "gram long, df long").select("gram"), "several")
        shared = self.spark.sparkContext.broadcast(bloom(several, several.count()))
        posted = stored(index.mapInArrow(_posted(shared), "sig long, nid long, n int, coarse binary, cells binary"), "posted")
        self.postings = stored(posted.where("sig is not null").select("sig", "nid", "n").distinct(), "postings")
        self.cells = stored(posted.where("sig is null").groupBy("nid").agg(F.first("coarse").alias("coarse"), F.first("cells").alias("cells")), "cells")
        discard(index, posted, several)

    def sets(self, nids: DataFrame) -> DataFrame:
        """(nid, grams) of these classes, from one document each. No text is moved: a filter of the documents' keys goes to the texts."""
        nids = stored(nids.distinct(), "nids")
        keys = self.rows.join(nids, "nid", "left_semi").groupBy("nid").agg(F.min("key").alias("key")).select("key")
        shared = self.spark.sparkContext.broadcast(bloom(keys, nids.count()))
        found = self.docs.select("key", "text").mapInArrow(_sets(self.width, shared), "nid long, grams binary")
        out = stored(found.groupBy("nid").agg(F.first("grams").alias("grams")).join(nids, "nid", "left_semi"), "sets")
        discard(nids)
        return out

    def _only(self, table: DataFrame, keys: DataFrame, most: int, name: str = "nid") -> DataFrame:
        """The rows of table that a filter of the column keys of at most so many values lets pass by their column name, stored: a join moves few others."""
        shared = self.spark.sparkContext.broadcast(bloom(keys, most))
        return stored(table.mapInArrow(_known(shared, name), table.schema), "only")

    def _with(self, pairs: DataFrame, table: DataFrame, value: str, run, kinds: str, name: str) -> DataFrame:
        """run over pairs(a, b, ...) with x and y, the values of table(nid, value) for a and b, stored.

        A class can be b of very many pairs: these are dealt out in shares, with a copy of the value for each.
        """
        most = pairs.count()
        own, other = (self._only(table.select("nid", value), pairs.select(c), most) for c in ("a", "b"))
        per = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
        several = per.where("shares > 1")  # at most a row per SHARE pairs
        y = other.select(F.col("nid").alias("b"), F.col(value).alias("y")).join(several, "b", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
        rows = pairs.join(several, "b", "left").withColumn("share", F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
        rows = rows.join(own.select(F.col("nid").alias("a"), F.col(value).alias("x")), "a").join(y, ["b", "share"])
        out = stored(rows.select(*pairs.columns, "x", "y").mapInArrow(run, kinds), name)
        discard(own, other)
        return out

    def _sifted(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) that coarse cells, then the fine ones, allow."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
        for value in ("coarse", "cells"):
            pairs = self._with(pairs, self.cells, value, _can_be_similar(self.percent), kinds, "sifted")
        return pairs

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, common, similar) of candidate pairs of classes: sifted twice, then compared on whole sets."""
        pairs = self._sifted(pairs.select("a", "b"))
        sets = self.sets(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")))
        out = self._with(pairs, sets, "grams", _verify(self.percent), "a long, b long, common long, similar boolean", "verified")
        discard(sets, pairs)
        return out

    def _fits(self, n: str, m: str):
        """Sizes that can be similar."""
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def _sized(self, p: DataFrame, few: bool = False) -> DataFrame:
        """p(sig, nid, n, d, at, side) of lists that can have pairs, with k, the list's length.

        side is 0 where all classes of a list are partners, else 1 and 2 are partners of each other.
        few: most lists can't, so that a filter leaves out most rows before they are moved.
        """
        size = p.groupBy("sig").agg(F.count("*").alias("k"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("k > 1 and (lo < hi or hi = 0)").select("sig", "k")
        if not few:
            return stored(p.join(size, "sig"), "sized")
        size = stored(size, "sizes")
        some = self._only(p, size.select("sig"), size.count(), "sig")
        out = stored(some.join(size, "sig"), "sized")
        discard(size, some)
        return out

    def _lists(self, p: DataFrame) -> DataFrame:
        """_sized lists with c, m, the centre and the centre's size."""
        weight = p.groupBy("nid").agg(F.sum("k").alias("w"))
        p = stored(p.join(weight, "nid"), "weighted")
        top = p.groupBy("sig").agg(F.max(F.struct("w", "nid", "n")).alias("t"))
        out = stored(p.drop("w").join(top.select("sig", F.col("t.nid").alias("c"), F.col("t.n").alias("m")), "sig"), "lists")
        discard(p)
        return out

    def _centred(self, lists: DataFrame) -> DataFrame:
        """(a, b, long) of each class and the centres of its lists; of short lists only pairs that can be similar by size."""
        star = lists.where((F.col("nid") != F.col("c")) & ((F.col("k") > SHORT) | self._fits("n", "m")))
        return stored(star.groupBy(F.col("nid").alias("a"), F.col("c").alias("b")).agg(F.max(F.col("k") > SHORT).alias("long")), "stars")

    def _compared(self, star: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, common, similar, d, half, sigs, own, spread) of pairs with a centre."""
        return self._with(star, sets, "grams", _verify(self.percent, self.frequent), "a long, b long, common long, similar boolean, d int, half int, sigs array<long>, own binary, spread binary", "compared")

    def _open(self, lists: DataFrame, comps: DataFrame) -> DataFrame:
        """lists with comp, without those whose classes are of one component."""
        q = stored(lists.join(comps.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid")), "named")
        per = q.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
        out = stored(q.join(per, "sig", "left_semi"), "open")
        discard(q)
        return out

    def _pairs(self, q: DataFrame) -> DataFrame:
        """Pairs (a, b), a > b, of classes of short lists from different components that sizes allow."""
        q = q.select("sig", "nid", "n", "comp")
        apart = (F.col("nid") > F.col("v")) & (F.col("comp") != F.col("cv"))
        pairs = q.join(q.toDF("sig", "v", "m", "cv"), "sig").where(apart & self._fits("n", "m"))
        return stored(pairs.select(F.col("nid").alias("a"), F.col("v").alias("b")).distinct(), "pairs")

    def _linked(self, q: DataFrame, compared: DataFrame) -> DataFrame:
        """(a, b) of similar classes of lists of differences, enough of them to join each list's components.

        A list is one task, which holds its differences; it has at most a link per class.
        """
        q = q.select("sig", "nid", "c", "n", "d", "at", "side", "comp")
        q = stored(q.groupBy("sig").applyInArrow(_partnered(self.percent), q.schema), "partnered")
        differences = compared.where("own is not null").withColumnRenamed("a", "nid").withColumnRenamed("b", "c")

        def having(value: str) -> tuple[DataFrame, DataFrame]:
            some = self._only(differences.select("nid", "c", value), q.select("nid"), q.count())
            return some, q.join(some, ["nid", "c"])

        some, lists = having("spread")
        fewer = stored(lists.groupBy("sig").applyInArrow(_partnered(self.percent), lists.schema).drop("spread"), "partnered")
        discard(q, some)
        q = fewer
        some, lists = having("own")
        out = stored(lists.groupBy("sig").applyInArrow(_joined(self.percent), "a long, b long"), "linked")
        discard(q, some)
        return out

    def class_links(self) -> DataFrame:
        """(a, b) of similar classes, enough of them to join every component."""
        collect_garbage(self.spark)
        none = F.lit(0)
        lists = self._lists(self._sized(self.postings.select("*", none.alias("d"), none.alias("at"), none.alias("side"))))
        star = self._centred(lists)
        near = stored(self._sifted(star.where("not long")).unionByName(star.where("long")), "near")
        sets = self.sets(near.select(F.col("a").alias("nid")).union(near.select("b")))
        compared = self._compared(near, sets)
        links = compared.where("similar").select("a", "b")
        comps = components(links)
        q = self._open(lists, comps)
        pairs = self._pairs(q.where(F.col("k") <= SHORT)).join(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
        # The long lists, by their centres: described anew where a centre's classes are still apart.
        long = q.where(F.col("k") > SHORT).select(F.col("nid").alias("a"), F.col("c").alias("b"), "n").distinct()
        again = long.join(compared.where("d is not null").drop("common", "own", "spread"), ["a", "b"]).select("a", "b", "n", "d", "half", "similar", F.posexplode("sigs").alias("at", "sig"))
        side = F.when(F.col("similar"), 2).when(F.col("at") < F.col("half"), 0).otherwise(1)
        at = F.when(side == 1, F.col("at") - F.col("half")).otherwise(F.col("at"))
        anew = self._sized(again.select("sig", F.col("a").alias("nid"), F.col("b").alias("c"), "n", "d", at.alias("at"), side.alias("side")), few=True)
        linked = self._linked(self._open(anew, comps), compared)
        discard(lists, q, anew, sets)
        apart = pairs.distinct().join(comps.toDF("a", "ca"), "a", "left").join(comps.toDF("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        return links.union(linked).union(self.verified(stored(apart.select("a", "b"), "rest")).where("similar").select("a", "b"))

    def class_components(self) -> DataFrame:
        """(node, comp) of the classes that have links."""
        return components(self.class_links())

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, class_id, component_id) of every row.

        class_id is the smallest doc_id with the same set, component_id the smallest
        that links reach. Documents without n-grams are alone in both.
        """
        full = self.rows.where("n > 0")
        classes = stored(full.groupBy("nid").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")
        linked = self.class_components().join(classes, F.col("node") == F.col("nid")).select("nid", "comp", "class_id")
        least = linked.groupBy("comp").agg(F.min("class_id").alias("component_id"))
        linked = linked.join(least, "comp").select("nid", "component_id")
        # Only classes with copies or links need a name other than that of their one document.
        named = classes.join(linked, "nid", "left").where("copies > 1 or component_id is not null")
        named = stored(named.select("nid", "class_id", F.coalesce("component_id", "class_id").alias("component_id")), "named")
        out = full.join(named, "nid", "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
        alone = self.rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
        return out.union(alone).withColumnRenamed("n", "n_shingles")


def ngram_jaccard(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document with its n-gram set's size, its class of equal sets and its component of linked classes."""
    return NgramJaccard(docs, width, percent).result()
