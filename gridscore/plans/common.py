"""Settings shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.operators.grid import participants
from gridscore.session import source_bytes

# Participant order is the report order; p5 comes first on purpose.
PEOPLE = participants([(f"p{n}", f"System {n}") for n in (5, 0, 1, 2, 3, 4, 6, 7)])
MORE_PEOPLE = [*PEOPLE, *participants([("p-none", "No rows")])]


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(F.col(name), digits))
    return df


def longs(*names: str) -> list[Column]:
    return [F.col(name).cast("bigint").alias(name) for name in names]


#: Bytes of source files whose rows one task of CPU-heavy work takes.
BYTES_PER_TASK = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows evenly for CPU-heavy work: at least one task for every slot of the cluster, and more as the source grows.

    The splits of a scan say nothing of its rows. A file is read by row groups, and a compact one may hold a million rows in
    one of many splits, all of them for one task.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-source_bytes(df) // BYTES_PER_TASK)))
