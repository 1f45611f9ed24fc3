"""Rejects documents whose statistics are multivariate outliers within their language and source.

Every document becomes a vector of transformed statistics. Per language and source
location and scatter are the minimum-covariance-determinant estimate: starting
from medians and quartile ranges, each concentration step keeps the share
``KEPT`` of the group's rows with the smallest distances and takes their mean
and covariance, until an estimate comes again; then all rows within the 0.975
quantile are taken once more. The same is estimated per language and over all rows,
and each group's estimate is drawn to that of its language, that to the one of all
rows, and that to a wide prior, as if ``PRIOR`` rows of it had been seen: the fewer
rows a group has the more, without a size at which something else holds. A row is
rejected when its squared Mahalanobis distance exceeds ``cutoff``.

A step needs one pass over the small table of vectors: rows are counted and
summed by (group, distance bin), combined before the shuffle, and the estimate
comes from the bins. The vectors are integers (1/1024 units), so that sums are
exact and results don't depend on the partitioning. Only groups and bins meet
in one task, never a group's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import column_of, ship, slices, stored, texts_of, unburden
from plexora.llm.textstats import TextStats

UNIT = 1024
#: name -> the least standard deviation that is taken for it. A statistic that hardly varies must not make one stray character an outlier.
FEATURES = {"x_length": 0.08, "x_symbols": 0.08, "x_lines": 0.20, "x_repeats": 0.12, "x_upper": 0.06, "x_marks": 0.06}
P = len(FEATURES)
#: Share of rows that the estimate is made of; bins per doubling of the distance.
KEPT, BINS = 0.75, 16
#: Estimates that a new one is compared with, and the steps after which a group's last estimate is taken.
CIRCLE, MOST_STEPS = 6, 60
#: Tasks that put the small tables of estimates together.
FEW_TASKS = 8
#: Rows that the estimate above a group counts as, ten a statistic; least deviations that the prior of all rows has as its own.
PRIOR, WIDE = 10 * P, 4


def _chi2_below(x: float, p: int) -> float:
    """P(chi-square with an even number p of degrees <= x)."""
    term = total = 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - float(np.exp(-x / 2)) * total


def _chi2_quantile(share: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_below(mid, p) < share else (lo, mid)
    return lo


#: Makes the scatter of the kept share consistent for normal data.
SCALE = KEPT / _chi2_below(_chi2_quantile(KEPT, P), P + 2)
#: The quantile up to which rows count in the last step, and the scale that goes with it.
NEAR = _chi2_quantile(0.975, P)
RESCALE = 0.975 / _chi2_below(NEAR, P + 2)
#: The default cutoff: chi-square quantile at 1 - 1e-9.
CUTOFF = _chi2_quantile(1 - 1e-9, P)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unburden()
    stats = TextStats()
    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]
    for whole in batches:
        for batch in slices(whole):
            s = stats(texts_of(batch))
            n = np.maximum(s["n_words"], 1)
            x = [
                np.log2(np.maximum(s["word_chars"], 1) / n),
                np.sqrt(s["n_symbols"] / n),
                np.sqrt(s["n_dup_lines"] / np.maximum(s["n_lines"], 1)),
                np.sqrt(s["n_repeat_words"] / n),
                s["n_upper"] / np.maximum(s["n_letters"], 1),
                np.sqrt(s["n_marks"] / np.maximum(s["n_chars"], 1)),
            ]
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, c) for c in names[:3]] + [pa.array(s[c]) for c in names[3:8]] + [pa.array(np.rint(v * UNIT).astype(np.int64)) for v in x], names
            )


SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{x} long" for x in FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
NAMES = list(FEATURES)


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns mu and inv (upper triangle, off-diagonal doubled)."""
    d = [F.col(x) / UNIT - F.col("mu")[i] for i, x in enumerate(NAMES)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + F.col("inv")[k] * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _inverse(cov: np.ndarray) -> list[float]:
    floors = np.array(list(FEATURES.values()))
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    inflate = np.maximum(sd, floors) ** 2 - np.diag(cov)
    inv = np.linalg.inv(cov + np.diag(inflate))
    return [float(inv[i, j] * (1 if i == j else 2)) for i, j in PAIRS]


def _steady(n: float, cov: np.ndarray) -> np.ndarray:
    """cov with smaller correlations the fewer rows it is from, so that it can be inverted."""
    w = n / (n + P + 1)
    return w * cov + (1 - w) * np.diag(np.diag(cov))


def _row(grp: str, n: float, mu: np.ndarray, cov: np.ndarray) -> tuple:
    return grp, float(n), [float(v) for v in mu], [float(cov[i, j]) for i, j in PAIRS], _inverse(_steady(n, cov))


def _matrix(upper: list[float]) -> np.ndarray:
    cov = np.zeros((P, P))
    for v, (i, j) in zip(upper, PAIRS, strict=True):
        cov[i, j] = cov[j, i] = v
    return cov


def _start(row_medians: pd.DataFrame) -> pd.DataFrame:
    """The first estimate of a group: medians and quartile ranges, no correlation."""
    out = []
    for r in row_medians.itertuples(index=False):
        q = np.array([list(getattr(r, f"q_{x}")) for x in NAMES]) / UNIT
        out.append(_row(r.grp, r.n, q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2)))
    return pd.DataFrame(out, columns=COLUMNS)


def _moments(part: pd.DataFrame, scale: float) -> pd.DataFrame:
    """Mean and covariance from sums, exact up to the last division."""
    n = float(part["k"].sum())
    mu = np.array([float(part[f"s_{i}"].sum()) for i in range(P)]) / n
    cov = _matrix([float(part[f"s_{i}_{j}"].sum()) / n - mu[i] * mu[j] for i, j in PAIRS])
    return pd.DataFrame([_row(part["grp"].iloc[0], n, mu / UNIT, cov * scale / UNIT**2)], columns=COLUMNS)


def _concentrate(bins: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of one group from its bins."""
    bins = bins.sort_values("bin")
    k = bins["k"].cumsum().to_numpy()
    return _moments(bins.iloc[: int(np.searchsorted(k, KEPT * k[-1])) + 1], SCALE)


def _reweighted(bins: pd.DataFrame) -> pd.DataFrame:
    return _moments(bins, RESCALE)


def drawn(n: float, mu: np.ndarray, cov: np.ndarray, to_mu: np.ndarray, to_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of n rows of the one and PRIOR rows of the other estimate together."""
    w = n / (n + PRIOR)
    d = mu - to_mu
    return w * mu + (1 - w) * to_mu, w * cov + (1 - w) * to_cov + w * (1 - w) * np.outer(d, d)


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, source, mu, inv) from the sizes and estimates of a group, its language and all rows."""
    prior = np.diag((WIDE * np.array(list(FEATURES.values()))) ** 2)
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            mu, cov = np.array(r.all_mu), prior
            for n, own_mu, own_cov in ((r.all_n, r.all_mu, r.all_cov), (r.lang_n, r.lang_mu, r.lang_cov), (r.own_n, r.own_mu, r.own_cov)):
                mu, cov = drawn(n, np.array(own_mu), _matrix(own_cov), mu, cov)
            out.append((r.lang, r.source, mu.tolist(), _inverse(cov)))
        yield pd.DataFrame(out, columns=["lang", "source", "mu", "inv"])


COLUMNS = ["grp", "n", "mu", "cov", "inv"]
ESTIMATE = "grp string, n double, mu array<double>, cov array<double>, inv array<double>"


def statistics(docs: DataFrame) -> DataFrame:
    """One row of statistics and transformed statistics (long, 1/1024 units) per document."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) if name in docs.columns else F.lit("").alias(name)

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("lang"), text("source"), text("text"))
    return rows.mapInArrow(_statistics, SCHEMA)


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _sums() -> list[Column]:
    return [F.count("*").alias("k"), *(F.sum(x).alias(f"s_{i}") for i, x in enumerate(NAMES)), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s_{i}_{j}") for i, j in PAIRS)]


def concentrated(rows: DataFrame) -> DataFrame:
    """(grp, n, mu, cov, inv) per group of rows(grp, *FEATURES), from the n rows of its last step.

    A group's steps end when an estimate comes again: it stands still, or, as bins
    are kept whole, it is one of a circle of at most CIRCLE. Sums are exact, so this is
    exact too. After MOST_STEPS steps a group that goes in a longer circle keeps its last.
    """
    quartiles = [F.expr(f"percentile({x}, array(0.25, 0.5, 0.75))").alias(f"q_{x}") for x in NAMES]  # of at most some thousand values
    estimate = stored(rows.groupBy("grp").agg(F.count("*").cast("double").alias("n"), *quartiles).coalesce(FEW_TASKS).mapInPandas(lambda it: map(_start, it), ESTIMATE), "mcd")
    bin_of = F.floor(BINS * F.log2(_distance() + 2.0**-12)).cast("int")
    # past: a group's last estimates, in its own row, so that no table but the one before is read.
    moving, still = estimate.withColumn("past", F.array(F.struct("mu", "inv"))), []
    while not moving.isEmpty():
        # A row per group and bin, in few tasks, as each task of a shuffle leaves files for every step.
        bins = rows.join(moving.select("grp", "mu", "inv"), "grp").groupBy("grp", bin_of.alias("bin")).agg(*_sums()).coalesce(FEW_TASKS)
        new = bins.groupBy("grp").applyInPandas(_concentrate, ESTIMATE).join(moving.select("grp", "past"), "grp")
        past = F.slice(F.concat(F.array(F.struct("mu", "inv")), "past"), 1, CIRCLE)
        new = stored(new.select(*COLUMNS, F.array_contains("past", F.struct("mu", "inv")).alias("again"), past.alias("past")).coalesce(FEW_TASKS), "mcd")  # a row per group
        still.append(new.where("again").select(*COLUMNS))
        moving = new.where("not again")
        if len(still) == MOST_STEPS:  # a longer circle than is looked for: its last estimate is as good as any of it
            still.append(moving.select(*COLUMNS))
            break
    return stored(reduce(DataFrame.unionByName, still, estimate.limit(0)).coalesce(FEW_TASKS), "mcd")


def mcd(rows: DataFrame) -> DataFrame:
    """The same from all rows near the concentrated estimate, n the group's size."""
    raw = concentrated(rows)
    near = rows.join(raw, "grp").where(_distance() <= NEAR).groupBy("grp").agg(*_sums())
    last = stored(near.groupBy("grp").applyInPandas(_reweighted, ESTIMATE).drop("n").coalesce(FEW_TASKS), "mcd")
    return last.join(rows.groupBy("grp").agg(F.count("*").cast("double").alias("n")), "grp").select(*COLUMNS)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    kept is false for rows that fail the base rules, else whether the squared
    distance is at most the cutoff. Null texts are empty, so they fail the base
    rules; a null language or source counts as the empty one; texts are read whole,
    however long they are; equal rows and rows with a null id are rows of their own;
    other columns are ignored; an empty table gives no rows.
    """
    rows = stored(statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    by = {"all": F.lit("all"), "lang": F.concat(F.lit("lang "), "lang"), "own": F.concat(F.lit("source "), F.to_json(F.array("lang", "source")))}
    good = rows.where("not base_failed")
    found = stored(mcd(good.select(F.explode(F.array(*by.values())).alias("grp"), *NAMES)).coalesce(FEW_TASKS), "mcd")
    # The names of the groups are stored too: as literals they would make the join with all rows' estimate one of every task with every task.
    groups = stored(good.select("lang", "source").distinct().select("lang", "source", *[grp.alias(f"{name}_grp") for name, grp in by.items()]).coalesce(FEW_TASKS), "groups")
    for name in by:
        groups = groups.join(found.select(F.col("grp").alias(f"{name}_grp"), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "mu", "cov")]), f"{name}_grp")
    estimate = stored(groups.mapInPandas(_combined, "lang string, source string, mu array<double>, inv array<double>").coalesce(FEW_TASKS), "estimates")
    scored = rows.join(estimate, ["lang", "source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", F.coalesce(kept, F.lit(False)).alias("kept"))
