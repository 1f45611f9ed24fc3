"""Reproducible weighted draws: hashes instead of a random generator, integer weights instead of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.functions.shares import shares

#: A key's items are cut into equal shares of its weight, PER_SLOT items each on average; SLOTS bounds the rows that one item is repeated in.
SLOTS, PER_SLOT = 1 << 20, 8


def h60(*parts: Column | str | int) -> Column:
    """A 60-bit hash of the parts as text, the same in every engine that has md5."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def numbers(count: int) -> Column:
    """The array 0..count-1."""
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def integer_weight(df: DataFrame, column: str = "weight", scale: int = 100) -> Column:
    """Whole-number weights: integers as they are, others in 1/scale units; null counts as 1, negatives as 0."""
    kind = df.schema[column].dataType.typeName()
    value = F.col(column) if kind in ("long", "integer", "short", "byte") else F.round(F.col(column) * scale)
    one = 1 if kind in ("long", "integer", "short", "byte") else scale
    return F.greatest(F.coalesce(value.cast("long"), F.lit(one)), F.lit(0))


def cumulated(items: DataFrame, keys: list[str], order: list[str], weight: str = "w") -> DataFrame:
    """items with lo, hi (their share of the key's line of weights), total and n_slots.

    A key whose weights are all zero is drawn from evenly.
    """
    all_of = Window.partitionBy(*keys)
    line = all_of.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    items = items.withColumn("hi", F.sum(weight).over(line)).withColumn("_k", F.count("*").over(line))  # first, as the sums over a key then need no sort of their own
    items = items.withColumn("_t", F.sum(weight).over(all_of)).withColumn("_n", F.count("*").over(all_of))
    even = F.col("_t") == 0
    items = items.withColumn("hi", F.when(even, F.col("_k")).otherwise(F.col("hi"))).withColumn("lo", F.col("hi") - F.when(even, F.lit(1)).otherwise(F.col(weight)))
    return items.withColumn("total", _total("_t", "_n")).withColumn("n_slots", _slots("_n")).where("hi > lo").drop("_t", "_k", "_n")


def _total(weight: str, n: str) -> Column:
    return F.when(F.col(weight) == 0, F.col(n)).otherwise(F.col(weight))


def _slots(n: str) -> Column:
    return F.least(F.lit(SLOTS), F.ceil(F.col(n) / PER_SLOT)).cast("long")


def slot_of(place: str) -> Column:
    """The number of the equal share of the key's line (total, n_slots) that a place on it falls into."""
    return F.expr(f"({place}) div ((total + n_slots - 1) div n_slots)")


def slotted(line: DataFrame) -> DataFrame:
    """Adds slot: an item stands in each equal share of the line that it reaches into, so that a draw meets few items even at a hub."""
    return line.withColumn("slot", F.explode(F.sequence(slot_of("lo"), slot_of("hi - 1"))))


def picked(draws: DataFrame, items: DataFrame, keys: list[str], order: list[str], hash_column: str = "h", weight: str = "w", how: str = "inner", few: str = "", rest: str = "", tasks: int = 0, asked: DataFrame | None = None) -> DataFrame:
    """Each row of draws joined with the item of its keys that its hash falls on.

    Draws of keys without items go, or stay with nulls where how is left. draws is used once.
    few: "keys" where these are some thousands at most, "items" where the items are; they are broadcast.
    rest: a column for the place within the item that the hash falls on. tasks: at least so many for a shuffle.
    asked: the keys that draws has, where that is cheap to know; other keys' items are left out early.
    """
    n = max(tasks, shares(items))
    if few != "items":
        items = items.repartition(n, *keys)
    if asked is not None:
        items = items.join(asked.select(*keys).distinct(), keys)  # no semi join: Spark would push it into each type's table
    heads = items.groupBy(*keys).agg(F.sum(weight).alias("_t"), F.count("*").alias("_n"))
    heads = heads.select(*keys, _total("_t", "_n").alias("total"), _slots("_n").alias("n_slots"))
    draws = draws.join(F.broadcast(heads) if few else heads, keys, how).withColumn("r", F.col(hash_column) % F.col("total"))
    draws = draws.withColumn("slot", slot_of("r")).drop("total", "n_slots")
    items = slotted(cumulated(items, keys, order, weight)).drop("total", "n_slots")
    items = F.broadcast(items) if few == "items" else items.repartition(n, *keys, "slot")
    if how == "inner":
        found = draws.join(items, [*keys, "slot"]).where("lo <= r and r < hi")
    else:
        items = items.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "slot"]], *[c for c in items.columns if c not in [*keys, "slot"]])
        same = [F.col(c) == F.col(f"_{c}") for c in [*keys, "slot"]]
        found = draws.join(items, [*same, F.col("lo") <= F.col("r"), F.col("r") < F.col("hi")], "left").drop(*[f"_{c}" for c in [*keys, "slot"]])
    found = found.drop(*[c for c in [hash_column] if c != rest])
    return (found.withColumn(rest, F.col("r") - F.col("lo")) if rest else found).drop("slot", "lo", "hi", "r")


def picked_within(rows: DataFrame, keys: list[str], order: list[str], hash_column: str = "h", weight: str = "w") -> DataFrame:
    """Of each key's rows the one that the key's hash, the same in all of them, falls on. One pass over rows, which may be costly to make."""
    all_of = Window.partitionBy(*keys)
    rows = rows.withColumn("_t", F.sum(weight).over(all_of))
    rows = rows.withColumn("_w", F.when(F.col("_t") == 0, F.lit(1).cast("long")).otherwise(F.col(weight)))
    line = all_of.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_hi", F.sum("_w").over(line)).withColumn("_r", F.col(hash_column) % F.sum("_w").over(all_of))
    return rows.where("_hi - _w <= _r and _r < _hi").drop("_t", "_w", "_hi", "_r", hash_column)
