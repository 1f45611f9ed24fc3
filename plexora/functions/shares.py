"""How many tasks a shuffle gets: in proportion to the files behind it, so that what one task holds doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files for each task of a shuffle.
SHARE_BYTES = 4 << 20


def shares(*tables: DataFrame) -> int:
    """One task for each SHARE_BYTES of the files that the tables read, as often as they read them; at least one per core.

    Spark's own coalescing gives a task what the cores leave of a shuffle, up to 64 MB compressed; a given number is kept.
    """
    spark = tables[0].sparkSession
    total, least = 0, min(spark.sparkContext.defaultParallelism, usual := int(spark.conf.get("spark.sql.shuffle.partitions")))
    for df in tables:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for k in range(leaves.size()):
            size = int(str(leaves.apply(k).stats().sizeInBytes()))
            if size < 1 << 60:
                total += size
            else:  # rows that come from no file have no known size
                least = usual
    return max(least, -(-total // SHARE_BYTES))
