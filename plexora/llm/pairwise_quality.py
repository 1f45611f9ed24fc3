"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, then a threshold by score quantile.

From labelled rows, pairs of a good and a bad document are preferences. Under the
Bradley-Terry model the good one wins with probability sigmoid(s(good) - s(bad));
with scores linear in the features this is logistic loss on feature differences.
Scores have no natural zero, so the threshold is the quantile of the training
scores at the share of bad documents, and results are sigmoid(score - threshold).

All labelled training rows count: they are dealt into blocks in which both values
occur, pairs are made within a block so that each of its rows is in some, and a step of
Newton's method sums over all blocks. The quantile is the exact one of all training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexora.llm.common import column_of, doc_text, held_out, power_of_two, ship, slices, stored, texts_of
from plexora.llm.textstats import TextStats

#: Preference pairs per row; rows of the more frequent label value in a block; cells that an exact quantile is looked for in at once.
PAIRS_EACH, BLOCK, CELLS = 8, 4096, 4096
#: Units of the sums that center and scale come from: whole numbers, so that no order of the rows changes them.
UNIT = 4096


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The feature matrix from the counts of TextStats."""
    n = np.maximum(s["n_words"], 1)
    chars, lines, letters = np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1), np.maximum(s["n_letters"], 1)
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            np.log2(np.maximum(s["word_chars"], 1) / n),
            np.sqrt(s["n_symbols"] / n),
            np.sqrt(s["n_bangs"] / n),
            np.sqrt(s["n_bars"] / n),
            np.sqrt(s["n_marks"] / chars),
            np.sqrt(s["n_upper"] / letters),
            np.sqrt(s["n_dup_lines"] / lines),
            np.sqrt(s["n_repeat_words"] / n),
            np.sqrt(s["n_same_words"] / n),
            s["n_distinct_words"] / n,
            np.log1p(n / lines),
            np.log1p(s["n_symbols"]),
            np.log1p(s["n_bangs"]),
            np.log1p(s["n_same_words"]),
            (s["n_words"] < 50).astype(float),
        ]
    )


@dataclass
class PairwiseModel:
    center: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float = 0.0

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - np.array(self.center)) / np.array(self.scale), -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.normal(x) @ np.array(self.weights)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stats = TextStats()
    for whole in batches:
        for batch in slices(whole):
            x = features(stats(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])


def _pull(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss on the differences d."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability that the bad one wins
    return d.T @ p, (d * (p * (1 - p))[:, None]).T @ d


def _newton(pull: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float) -> np.ndarray:
    w = np.zeros(width)
    for _ in range(30):
        g, h = pull(w)
        step = np.linalg.solve(h + ridge * np.eye(width), g - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = 1.0, each: int = PAIRS_EACH) -> np.ndarray:
    """Weights that minimise logistic loss on the differences of preference pairs, by Newton's method."""
    rng = np.random.default_rng(7)
    bads = np.repeat(np.arange(len(bad)), each)
    d = good[rng.integers(0, len(good), len(bads))] - bad[bads]
    return _newton(lambda w: _pull(d, w), d.shape[1], ridge)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _block(model: PairwiseModel):
    """The differences of a block's pairs: rows of both values are taken in turn, each of them PAIRS_EACH times at least."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at").combine_chunks()
        x, y = np.array(table.column("x").to_pylist()), table.column("y").to_numpy()
        z = model.normal(x)
        good, bad = z[y == 1], z[y == 0]
        block = table.column("block")[0].as_py()
        rng, most = np.random.default_rng([7, block]), max(len(good), len(bad))
        d = np.concatenate([good[np.resize(rng.permutation(len(good)), most)] - bad[np.resize(rng.permutation(len(bad)), most)] for _ in range(PAIRS_EACH)])
        return pa.table({"block": pa.array([block], pa.int64()), "d": pa.array([d.tobytes()], pa.binary())})

    return run


def _blocks(train: DataFrame, model: PairwiseModel, sizes: dict[int, int]) -> DataFrame:
    """(block, d) of all rows(doc_id, y, x). Blocks share out the more frequent value; rows of the other are in as many as leave none without."""
    most, least = max(sizes.values()), min(sizes.values())
    often = max(sizes, key=lambda k: sizes[k])
    blocks = -(-most // BLOCK)
    copies = min(blocks, max(1, -(-8 * blocks // least)))
    shares = power_of_two((most + least) / BLOCK)
    rows = train.withColumn("h", F.xxhash64("doc_id")).withColumn("share", F.pmod("h", F.lit(shares)).cast("int"))
    counts, before = rows.groupBy("y", "share").count().orderBy("y", "share").collect(), []
    for y in sizes:
        own = [r for r in counts if r["y"] == y]
        before += [(y, r["share"], n) for r, n in zip(own, np.cumsum([0] + [r["count"] for r in own]).tolist(), strict=False)]
    first = train.sparkSession.createDataFrame(before, "y int, share int, first long")
    place = F.row_number().over(Window.partitionBy("y", "share").orderBy("h", "doc_id", "x")) - 1
    rows = rows.withColumn("place", place).join(first, ["y", "share"]).withColumn("at", F.col("place") + F.col("first"))
    copy = F.explode(F.when(F.col("y") == often, F.array(F.floor(F.col("at") / BLOCK))).otherwise(F.transform(F.sequence(F.col("at") * copies, F.col("at") * copies + copies - 1), lambda k: k % blocks)))
    rows = rows.select("y", "x", "at", copy.alias("block"))
    return stored(rows.groupBy("block").applyInArrow(_block(model), "block long, d binary"), "pairs")


def _summed(blocks: DataFrame, width: int):
    """w -> gradient and curvature over all blocks, added in the blocks' order; a block sends width * (width + 1) numbers."""

    def pull(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    g, h = _pull(np.frombuffer(d.as_buffer()).reshape(-1, width), w)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.vstack([g, h]).tobytes()], pa.binary())], ["block", "sums"])

        found = blocks.mapInArrow(run, "block long, sums binary").collect()
        total = sum((np.frombuffer(r["sums"]).reshape(width + 1, width) for r in sorted(found, key=lambda r: r["block"])), np.zeros((width + 1, width)))
        return total[0], total[1:]

    return pull


def smallest(values: DataFrame, k: int) -> float:
    """The value of rank k (from 0) of the only column, exactly: cells between the least and the largest are counted, then those within one cell."""
    name = values.columns[0]
    lo, hi = values.agg(F.min(name), F.max(name)).first()
    while lo < hi:
        cell = F.floor((F.col(name) - lo) / (hi - lo) * CELLS)
        inside = values.where(F.col(name).between(lo, hi)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"))
        for r in sorted(inside.collect(), key=lambda r: r["cell"]):
            if k < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row: its features."""
    return doc_text(docs).mapInArrow(_features, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> PairwiseModel:
    """Learns from all labelled training rows."""
    return fit_vectors(vectors(docs), labels, label)


def fit_vectors(rows: DataFrame, labels: DataFrame, label: str = "quality") -> PairwiseModel:
    """The same from the features of documents."""
    ship(rows.sparkSession)
    width = features({k: np.zeros(1, dtype=np.int64) for k in TextStats()([""])}).shape[1]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    train = stored(rows.join(known, "doc_id").select("doc_id", "y", "x"), "train")
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().orderBy("y").collect()}
    if len(sizes) < 2:
        return PairwiseModel([0.0] * width, [1.0] * width, [0.0] * width)
    units = [F.rint(F.col("x")[i] * UNIT).cast("long") for i in range(width)]
    n = sum(sizes.values())
    sums = np.array(train.agg(*[F.sum(u) for u in units], *[F.sum(u * u) for u in units]).first(), dtype=float) / n
    center = sums[:width] / UNIT
    scale = np.maximum(np.sqrt(np.maximum(sums[width:] / UNIT**2 - center**2, 0)), 1e-3)
    model = PairwiseModel(center.tolist(), scale.tolist(), [0.0] * width)
    model.weights = _newton(_summed(_blocks(train, model, sizes), width), width, 1.0).tolist()

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0), width)))], ["raw"])

    scores = stored(train.select("x").mapInArrow(raw, "raw double"), "raw")
    k = sizes[0]  # as many training scores are below the threshold as rows are bad
    model.threshold = (smallest(scores, k - 1) + smallest(scores, k)) / 2
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            z = model.raw(_matrix(column_of(batch, "x"), len(model.weights))) - model.threshold
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return run


def score(rows: DataFrame, model: PairwiseModel) -> DataFrame:
    """(doc_id, score) of rows of features."""
    ship(rows.sparkSession)
    return rows.mapInArrow(_scored(rows.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def pairwise_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """quality by the model that fit learns; the texts are read once, as their features are stored."""
    rows = stored(vectors(docs), "features")
    return score(rows, fit_vectors(rows, labels, label))


def quality(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """(doc_id, score) of every row, the score in 0..1 and at least 0.5 for documents at or above the threshold.

    Null texts are scored as empty ones; texts are read whole, however long they are;
    equal rows and rows with a null id are scored each; other columns are ignored; an
    empty table gives no rows. Without labels of both values every score is 0.5.
    """
    return score(vectors(docs), model)
