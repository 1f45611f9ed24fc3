"""Token ids of all documents in grammar-compressed files.

Documents are put in ascending doc_id order (range partitions, sorted within) and
encoded; about ``SHARD_IDS`` ids make a shard. A shard is compressed by Re-Pair:
in each round the most frequent adjacent pairs become new symbols and are replaced
from left to right, until no pair is frequent enough. The file holds the rules,
every symbol's expansion length, the remaining symbols, and each document's id and
length, so that one document is decoded without the others: expansion lengths
are summed to find the symbols that overlap it.

File format (little-endian): magic ``PLXRPAIR``, then uint64 numbers of documents,
ids, symbols, rules, and the first terminal beyond the vocabulary; then zstandard
frames, each after its uint64 length: document ids (int64), document lengths
(int64), rules (2 uint32 each), expansion lengths of rules (uint32), symbols (uint32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import column_of, doc_text, new_folder, plan_bytes, slices, stored, texts_of
from plexora.llm.files import read_files, write_file
from plexora.llm.tokens import gather, word_tokenizer

MAGIC = b"PLXRPAIR"
#: Ids of a shard; pairs of a round of replacement, and the least count of a replaced pair.
SHARD_IDS, PAIRS, LEAST = 2_000_000, 8192, 8
#: Cells that pairs are counted in.
CELLS = 1 << 20
#: What stands for a null document id in a file.
NO_ID = -(1 << 63)


def _cells(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)


def _pairs_of(seq: np.ndarray, keep: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a << 32 | b) of adjacent pairs, and their cells of a hash table; pairs that begin with keep are in the cell behind the others."""
    keys = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
    cells = _cells(keys)
    if keep is not None:
        cells[seq[:-1] == keep] = CELLS
    return keys, cells


def _counts(cells: np.ndarray) -> np.ndarray:
    counts = np.bincount(cells, minlength=CELLS + 1)
    counts[CELLS] = 0
    return counts


def replaced_pairs(seq: np.ndarray, most: int, least: int, keep: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, positions, number of the pair at each): the most frequent adjacent pairs, and where they stand."""
    keys, cells = _pairs_of(seq, keep)
    return _frequent(keys, cells, _counts(cells), most, least)


def _frequent(keys: np.ndarray, cells: np.ndarray, counts: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs are counted in the cells of a hash table, and exactly in the fullest cells;
    where those hold no pair that is frequent enough, in all cells that may hold one.
    """
    bounds, full = [least], counts >= least
    if np.count_nonzero(full) > most:
        bounds.insert(0, int(np.partition(counts[full], -most)[-most]))
    for bound in bounds:
        # Sorted without their places, so that a shard's pairs are held once.
        places = np.flatnonzero((counts >= bound)[cells])
        some = np.sort(keys[places])
        begin = np.flatnonzero(np.r_[len(some) > 0, some[1:] != some[:-1]])
        n = np.diff(np.r_[begin, len(some)])
        often = np.flatnonzero(n >= least)
        pairs, n = some[begin[often]], n[often]
        del some, begin, often
        if len(pairs):
            break
    pairs = pairs[np.lexsort((pairs, -n))[:most]]
    own, cells = _cells(pairs), cells[places]
    number = np.full(len(places), -1, dtype=np.int32)
    table = np.full(CELLS + 1, -1, dtype=np.int32)
    todo = np.arange(len(pairs), dtype=np.int32)
    while len(todo):  # of pairs that share a cell, one at a time
        of_cell, which = np.unique(own[todo], return_index=True)
        table[of_cell] = todo[which]
        found = table[cells]
        at = np.flatnonzero(found >= 0)
        at = at[pairs[found[at]] == keys[places[at]]]
        number[at] = found[at]
        table[of_cell] = -1
        todo = np.delete(todo, which)
    at = np.flatnonzero(number >= 0)
    return pairs, places[at], number[at]


def _among(seq: np.ndarray, at: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As replaced_pairs, of the pairs at some positions; also the positions of all pairs that are frequent enough."""
    keys = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
    found, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    often = np.flatnonzero(n >= least)
    often = often[np.lexsort((found[often], -n[often]))[:most]]
    rank = np.full(len(found), -1, dtype=np.int64)
    rank[often] = np.arange(len(often))
    number = rank[which]
    hit = number >= 0
    return found[often], at[hit], number[hit], at[(n >= least)[which]]


def re_pair(ids: np.ndarray, base: int, keep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules[i] = (a, b) is what symbol base + i stands for. keep is an id that no pair begins with.

    A pair gets more frequent only by new symbols. So once the pairs that may be frequent
    stand at few places, later rounds look at what is left of those and beside new symbols.
    """
    seq, rules, near = ids.astype(np.uint32), [], None
    while len(seq) > 1:
        if near is None:
            keys, cells = _pairs_of(seq, keep)
            counts = _counts(cells)
            full = counts >= LEAST
            places = np.flatnonzero(full[cells]) if np.count_nonzero(full) <= PAIRS else ()
            if len(places) and 4 * len(places) <= len(seq):
                near = places
            else:
                pairs, pos, number = _frequent(keys, cells, counts, PAIRS, LEAST)
            del keys, cells, counts
        if near is not None:
            pairs, pos, number, near = _among(seq, near, PAIRS, LEAST)
        if not len(pairs):
            break
        first = base + sum(map(len, rules))
        # Of overlapping hits every other one is taken, counted from the first of the run.
        new_run = np.r_[True, np.diff(pos) > 1]
        start = np.maximum.accumulate(np.where(new_run, pos, 0))
        taken = (pos - start) % 2 == 0
        pos, number = pos[taken], number[taken]
        # Without pairs that lost all their places to others.
        stand = np.bincount(number, minlength=len(pairs)) > 0
        pairs, number = pairs[stand], (np.cumsum(stand) - 1)[number]
        keep_mask = np.ones(len(seq), dtype=bool)
        keep_mask[pos + 1] = False
        seq[pos] = (first + number).astype(np.uint32)
        seq = seq[keep_mask]
        rules.append(np.column_stack([(pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)]))
        if near is not None:
            near = near[keep_mask[near]]
            near = near - np.searchsorted(pos + 1, near)  # removed symbols before each
            pos = pos - np.arange(len(pos))
            near = np.unique(np.concatenate([near, pos - 1, pos]))
            near = near[(near >= 0) & (near < len(seq) - 1)]
            if keep is not None:
                near = near[seq[near] != keep]
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only names symbols before it."""
    lengths = np.zeros(len(rules), dtype=np.uint32)
    if not len(rules):
        return lengths
    while not lengths.all():
        todo = np.flatnonzero(lengths == 0)
        parts = []
        for side in (0, 1):
            s = rules[todo, side].astype(np.int64)
            parts.append(np.where(s < base, 1, lengths[np.maximum(s - base, 0)]))
        lengths[todo] = np.where((parts[0] > 0) & (parts[1] > 0), parts[0] + parts[1], 0)
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = symbols
    while len(big := np.flatnonzero(seq >= base)):
        out = np.repeat(seq, 1 + (seq >= base))
        at = big + np.arange(len(big))
        pair = rules[seq[big].astype(np.int64) - base]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def write_shard(doc_ids: list[int], ids: list[np.ndarray], base: int, end_id: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.uint32)
    seq, rules = re_pair(flat, base, end_id)
    parts = [np.array(doc_ids, dtype="<i8"), np.array([len(x) for x in ids], dtype="<i8"), rules.astype("<u4"), rule_lengths(rules, base).astype("<u4"), seq.astype("<u4")]
    packer = zstandard.ZstdCompressor(level=1)
    frames = [packer.compress(p.tobytes()) for p in parts]
    return MAGIC + struct.pack("<5Q", len(doc_ids), len(flat), len(seq), len(rules), base) + b"".join(struct.pack("<Q", len(f)) + f for f in frames)


class Shard:
    """A shard's file, decoded in whole or one document at a time."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("this is no shard file")
        self.n_docs, self.n_ids, n_seq, n_rules, self.base = struct.unpack_from("<5Q", data, 8)
        at, parts = 48, []
        sizes = [8 * self.n_docs, 8 * self.n_docs, 8 * n_rules, 4 * n_rules, 4 * n_seq]
        for size in sizes:
            (n,) = struct.unpack_from("<Q", data, at)
            parts.append(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + n], max_output_size=max(size, 1)))
            at += 8 + n
        self.doc_ids, self.lengths = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<i8")
        self.rules, self.rule_lengths, self.seq = np.frombuffer(parts[2], "<u4").reshape(-1, 2), np.frombuffer(parts[3], "<u4"), np.frombuffer(parts[4], "<u4")

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def all(self) -> np.ndarray:
        """All ids; every rule is expanded once."""
        single = np.arange(self.base, dtype=np.uint32)
        rules = expand(np.arange(self.base, self.base + len(self.rules), dtype=np.uint32), self.rules, self.base)
        return gather(np.concatenate([single, rules]), np.concatenate([np.ones(self.base, dtype=np.int64), self.rule_lengths]), self.seq)[0]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only the symbols that overlap it are expanded."""
        s = self.seq.astype(np.int64)
        sizes = np.where(s < self.base, 1, self.rule_lengths[np.maximum(s - self.base, 0)] if len(self.rules) else 1)
        ends = np.cumsum(sizes)
        start = int(self.starts()[k])
        stop = start + int(self.lengths[k])
        i, j = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        ids = expand(self.seq[i:j], self.rules, self.base)
        skip = start - (int(ends[i - 1]) if i else 0)
        return ids[skip : skip + stop - start]


def _write(tokenizer: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_tokenizer(tokenizer), TaskContext.get().partitionId()
        base = encode.tokenizer.get_vocab_size(with_added_tokens=True)
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            name = f"part-{part:06d}-{number:06d}.rpair"
            write_file(folder, name, write_shard(doc_ids, ids, base, end_id))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([size], pa.int64())], ["part", "number", "name", "n_ids"])
            doc_ids.clear()
            ids.clear()
            size, number = 0, number + 1
            return row

        for whole in batches:
            for batch in slices(whole):
                flat, sizes = encode.flat(texts_of(batch), end_id)
                ends = np.cumsum(sizes).tolist()
                for i, a, b in zip(column_of(batch, "doc_id").to_pylist(), [0, *ends], ends, strict=False):
                    doc_ids.append(i)
                    ids.append(flat[a:b])
                    size += b - a
                    if size >= SHARD_IDS:
                        yield flush()
        if doc_ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Writes the shards into folder (or a new one in the shared folder) and returns their index: name, part, number, n_ids, start.

    start is the number of ids in all shards before. Null texts are empty, so they
    are one id long; texts of any length are encoded whole; rows with a null doc_id
    come first; equal ids follow each other, by a hash of the text and the text, and
    may lie in several tasks; other columns are ignored.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = doc_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    partitions = partitions or max(1, min(100_000, plan_bytes(rows) // (16 << 20) + 1))
    rows = rows.repartitionByRange(partitions, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    index = stored(rows.mapInArrow(_write(tokenizer, end_id, folder), "part int, number int, name string, n_ids long"), "shards")
    per = index.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = per.select("part", F.expr("sum(part_ids) over (order by part) - part_ids").alias("before"))  # a row per partition
    own = F.expr("sum(n_ids) over (partition by part order by number) - n_ids")
    index = index.withColumn("own", own).join(before, "part")
    return index.select("name", "part", "number", "n_ids", (F.col("own") + F.col("before")).alias("start"), F.lit(folder).alias("folder"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(column_of(batch, "name").to_pylist(), column_of(batch, "content"), strict=True):
            shard = Shard(content.as_buffer().to_pybytes())
            data = memoryview(shard.all().astype("<u4", copy=False)).cast("B")
            starts = shard.starts()
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), shard.lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc)), pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(starts), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["name", "doc_id", "own", "n_tokens", "ids_crc32"])


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = read_files(index.sparkSession, folder, "*.rpair").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.mapInArrow(_read, "name string, doc_id long, own long, n_tokens long, ids_crc32 long")
    return rows.join(index.select("name", F.col("start").alias("before")), "name").select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes all documents' ids and returns what the files hold."""
    folder = new_folder(docs.sparkSession, "tokens")
    index = stored(write_token_files(docs, tokenizer, end_id, folder), "index")
    if index.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(index, folder)
