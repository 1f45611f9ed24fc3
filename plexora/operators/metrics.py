"""Scores, losses and metrics over rows of logits and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.functions.vectors import cosine, dot, sigmoid


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logits(rows: DataFrame, a: str = "target", b: str = "context", to: str = "logit") -> DataFrame:
    return rows.withColumn(to, dot(a, b))


def neg_cross_entropy(rows: DataFrame) -> DataFrame:
    """rows(pos, logit, positive) -> loss: per pos the sum of softplus(-logit) of positives and softplus(logit) of negatives, averaged."""
    x = F.col("logit")
    per = rows.groupBy("pos").agg(F.sum(F.when(F.col("positive"), softplus(-x)).otherwise(softplus(x))).alias("s"))
    return per.agg(F.avg("s").alias("loss"))


def binary_cross_entropy(rows: DataFrame) -> DataFrame:
    """rows(logit, label) -> loss."""
    return rows.agg(F.avg(softplus(F.col("logit")) - F.col("logit") * F.col("label")).alias("loss"))


def softmax_cross_entropy(rows: DataFrame) -> DataFrame:
    """rows(logits, label) with class numbers from 0 -> loss."""
    top = F.array_max("logits")
    log_sum = F.log(F.aggregate("logits", F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top
    return rows.agg(F.avg(log_sum - F.element_at("logits", (F.col("label") + 1).cast("int"))).alias("loss"))


def multi_label_soft_margin(rows: DataFrame) -> DataFrame:
    """rows(logits, labels of 0 and 1) -> loss: mean over classes and rows."""
    each = F.zip_with("logits", "labels", lambda x, y: y * softplus(-x) + (1 - y) * softplus(x))
    return rows.agg(F.avg(F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size("logits")).alias("loss"))


def nce_loss(rows: DataFrame) -> DataFrame:
    """rows(pos, x, w, b, positive, expected): logit x . w + b - log(expected), then as neg_cross_entropy."""
    return neg_cross_entropy(rows.withColumn("logit", dot("x", "w") + F.col("b") - F.log("expected")))


def mrr(rows: DataFrame) -> DataFrame:
    """rows(pos, logit, positive) with one positive per pos -> mrr; a negative that ties stands before the positive."""
    own = F.max(F.when(F.col("positive"), F.col("logit"))).over(Window.partitionBy("pos"))
    rank = rows.withColumn("own", own).where("not positive or logit = own").groupBy("pos").agg((1 + F.sum(F.when(~F.col("positive") & (F.col("logit") >= F.col("own")), 1).otherwise(0))).alias("rank"))
    return rank.agg(F.avg(1 / F.col("rank")).alias("mrr"))


def soft_f1(rows: DataFrame) -> DataFrame:
    """rows(logit, label) -> f1 with sigmoid(logit) as counts; 0 without any."""
    p, y = sigmoid("logit"), F.col("label")
    s = rows.agg(F.sum(p * y).alias("tp"), F.sum(p).alias("all_p"), F.sum(y).alias("all_y"))
    total = F.col("all_p") + F.col("all_y")
    return s.select(F.when(total == 0, 0.0).otherwise(2 * F.col("tp") / total).alias("f1"))


def hard_f1(rows: DataFrame, eps: float = 1e-7) -> DataFrame:
    """rows(logit, label) -> f1, precision, recall of floor(sigmoid + 0.5)."""
    p, y = F.floor(sigmoid("logit") + 0.5).cast("double"), F.col("label").cast("double")
    s = rows.agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"))
    s = s.select((F.col("tp") / (F.col("tp") + F.col("fp") + eps)).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn") + eps)).alias("recall"))
    return s.select((2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)).alias("f1"), "precision", "recall")


def predicted_class(logits: str = "logits") -> Column:
    """The class number of the largest logit, the first of equal ones."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def accuracy(rows: DataFrame) -> DataFrame:
    """rows(logits, label) -> accuracy."""
    return rows.agg(F.avg((predicted_class() == F.col("label")).cast("double")).alias("accuracy"))


def cosine_similarity(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return rows.withColumn("cosine", cosine(a, b))


def class_f1(rows: DataFrame) -> DataFrame:
    """rows(predicted, label) -> macro_f1, micro_f1 over the classes that appear."""
    counts = rows.select(F.col("label").alias("c"), (F.col("predicted") == F.col("label")).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("predicted") != F.col("label")).cast("long").alias("fn"))
    wrong = rows.where("predicted <> label").select(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    per = counts.union(wrong).groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))

    def f1(tp, fp, fn):  # noqa: ANN001, ANN202
        return F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn))

    return per.agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"))


def auc(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows(score, label of 0 and 1, *keys) -> (*keys, auc), ties counting half.

    Counted over different scores: a running count over the blocks of score ranges
    and within them would be needed only where one key has more different scores
    than a task can sort.
    """
    per = rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count("*").alias("n")).withColumn("q", F.col("n") - F.col("p"))
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    won = per.withColumn("before", F.coalesce(F.sum("q").over(below), F.lit(0)))
    out = won.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("before") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return out.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).alias("auc"))


def link_f1(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows(score, label, *keys) -> (*keys, f1): as many rows are called true as there are, those with the largest scores and all that tie with the last."""
    # Counted over different scores, as in auc: a key's rows are never gathered, only its scores are.
    per = rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    all_of = Window.partitionBy(*keys)
    down = all_of.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = per.withColumn("place", F.sum("n").over(down)).withColumn("true", F.sum("p").over(all_of))
    last = (F.col("place") >= F.col("true")) & (F.col("place") - F.col("n") < F.col("true"))
    called = ranked.withColumn("floor", F.max(F.when(last, F.col("score"))).over(all_of)).withColumn("yes", (F.col("score") >= F.col("floor")).cast("long"))
    s = called.groupBy(*keys).agg(F.sum(F.col("yes") * F.col("p")).alias("tp"), F.sum(F.col("yes") * F.col("n")).alias("yes"), F.sum("p").alias("true"))
    return s.select(*keys, (2 * F.col("tp") / (F.col("yes") + F.col("true"))).alias("f1"))


def link_scores(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """pairs(..., a, b) and embeddings(id, embedding) -> pairs with score, the cosine of the two; an id's vectors are averaged, pairs with an unknown id go."""
    size = F.posexplode("embedding")
    mean = embeddings.select("id", size.alias("i", "v")).groupBy("id", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = mean.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("x"))  # as many as a vector has
    found = pairs.join(mean.toDF("a", "_x"), "a").join(mean.toDF("b", "_y"), "b")
    return found.withColumn("score", cosine("_x", "_y")).drop("_x", "_y")


def link_quality(rows: DataFrame, key: str) -> DataFrame:
    """rows(score, label, key) -> auc, f1: each per value of key (an edge type), averaged over the values that have both labels."""
    both = auc(rows, (key,)).where("auc is not null").join(link_f1(rows, (key,)), key)
    return both.agg(F.avg("auc").alias("auc"), F.avg("f1").alias("f1"))


LOSSES = {"neg_cross_entropy": neg_cross_entropy, "multi_label_sm": multi_label_soft_margin, "binary_cross_entropy": binary_cross_entropy, "softmax_cross_entropy": softmax_cross_entropy, "nce": nce_loss}
METRICS = {"mrr": mrr, "soft_f1": soft_f1, "f1": hard_f1, "acc": accuracy, "auc": auc, "class_f1": class_f1, "link_f1": link_f1, "cos": cosine_similarity}


def _get(table: dict[str, Callable], what: str, name: str | Callable) -> Callable:
    if callable(name):
        return name
    if name not in table:
        raise ValueError(f"{name} is no {what}; there are {sorted(table)}")
    return table[name]


def get_loss(name: str | Callable) -> Callable:
    return _get(LOSSES, "loss", name)


def get_metric(name: str | Callable) -> Callable:
    return _get(METRICS, "metric", name)
