"""The best k of numbered rows for many queries: what exact dense and sparse search share.

Rows are written once in the order of their key and numbered in it, so that a number stands for the key in ties too. The
tasks read their share of that table, hold a bounded batch of queries, and hand on k numbers and scores for each query;
neither rows nor queries are repeated on disk for each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.plans.stage import discard, write_stage

#: Scores are compared after rounding to so many decimals; what may round up to the least kept score is kept till then.
DECIMALS, SLACK = 9, 1e-8
#: Cells of the bitmap (512 kB) that keeps rows out of a shuffle.
CELLS = 1 << 22


def numbered(rows: DataFrame, key: str, least: int, written: bool = False) -> DataFrame:
    """A stage table of the rows with a column ``n`` that rises with the key, in files of ``least`` rows or more. The ranges are sampled, so the rows are written before, unless they are ``written``."""
    once = rows if written else write_stage(rows, "unordered")
    out = write_stage(once.repartitionByRange(n_tasks(rows.sparkSession, once.count(), least), key).sortWithinPartitions(key).withColumn("n", F.monotonically_increasing_id()), "numbered")
    if not written:
        discard(once)
    return out


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, q): a stage table with a number for each different id."""
    return write_stage(queries.select("query_id").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")


def n_tasks(spark, n_rows: int, least: int) -> int:
    """A task for each core, if each then has ``least`` rows. A task reads its rows in bounded blocks, however many they are, and each adds k rows a query to the merge."""
    return max(1, min(-(-n_rows // least), spark.sparkContext.defaultParallelism))


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a task in blocks of at most so many."""
    held, size = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, most - size)
            held, size, batch = [*held, part], size + len(part), batch.slice(len(part))
            if size == most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Best:
    """The k best (number, score) of each query so far; ties go to the lower number."""

    def __init__(self, n_queries: int, k: int, also: bool = False):
        self.k = k
        self.least = np.full(n_queries, -np.inf)
        self.n, self.score = [np.empty(0, np.int64)] * n_queries, [np.empty(0)] * n_queries
        self.also = [np.empty(0, np.int32)] * n_queries if also else None

    def offer(self, i: int, row: np.ndarray, n: np.ndarray, floor: float = -np.inf, also: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        """Scores of a block of rows, in the order of their numbers ``n``; those at or below ``floor`` don't count. ``also`` gives another number of the rows at some places, which is kept with them."""
        k, least = self.k, self.least[i]
        if least == -np.inf and len(row) >= 16 * k:
            # the k-th greatest of the maxima of groups: k rows are at least as good
            groups = row[: len(row) // (8 * k) * (8 * k)].reshape(8 * k, -1).max(axis=1)
            least = np.partition(groups, -k)[-k]
        found = np.flatnonzero(row >= least - SLACK)
        if floor > -np.inf:
            found = found[row[found] > floor]
        if not len(found):
            return
        score = np.concatenate([self.score[i], np.round(row[found], DECIMALS)])
        number = np.concatenate([self.n[i], n[found]])
        best = np.lexsort((number, -score))[:k]
        self.n[i], self.score[i] = number[best], score[best]
        if self.also is not None:
            self.also[i] = np.concatenate([self.also[i], also(found)])[best]
        if len(best) == k:
            self.least[i] = self.score[i][-1]

    def batches(self, q: np.ndarray, size: int = 2_000) -> Iterator[pa.RecordBatch]:
        some = [i for i in range(len(q)) if len(self.n[i])]
        for at in range(0, len(some), size):
            part = some[at : at + size]
            ends = np.cumsum([0, *(len(self.n[i]) for i in part)]).astype(np.int32)
            kept = {"ns": self.n, "scores": self.score} | ({} if self.also is None else {"alsos": self.also})
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([x[i] for i in part])) for x in kept.values()]
            yield pa.RecordBatch.from_arrays([pa.array(q[part], pa.int64()), *lists], ["q", *kept])


def best_numbers(rows: DataFrame, passes: list[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], k: int, also: str | None = None) -> DataFrame:
    """(q, n, rank, score), and the column ``also`` if the passes give it: runs each pass, a batch of queries each, over the rows, and merges what its tasks hand on."""
    lists = {"ns": "n", "scores": "score"} | ({"alsos": also} if also else {})
    kinds = "q bigint, ns array<bigint>, scores array<double>" + ", alsos array<int>" * bool(also)
    if not passes:
        kinds = "q bigint, n bigint, rank int, score double" + f", {also} int" * bool(also)
        return rows.sparkSession.createDataFrame([], kinds)
    found = reduce(DataFrame.unionByName, (rows.mapInArrow(p, kinds) for p in passes))
    # the lists are shuffled before they are unfolded
    each = found.repartition("q").select("q", F.explode(F.arrays_zip(*lists)).alias("v")).select("q", *(F.col(f"v.{x}").alias(name) for x, name in lists.items()))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "n")
    best = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("q", "n", "rank", "score", *([also] if also else []))


def best_of(rows: DataFrame, passes: list[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], queries: DataFrame, numbers: DataFrame, key: str, k: int, also: str | None = None) -> DataFrame:
    """(query_id, key, rank, score, ...): ``best_numbers`` with the ids that the numbers stand for. queries: ``asked``, numbers: (n, key)."""
    best = best_numbers(rows, passes, k, also)
    return best.join(queries, "q").join(numbers.select("n", key), "n").select("query_id", key, "rank", "score", *([also] if also else []))


def thinned(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the ``wanted`` ones, to be joined with them: long texts that no one asks for are then not shuffled. A bitmap of fixed size goes to the tasks; rows of other keys in the same cells pass too, and none that is wanted is lost."""
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")
    held = np.zeros(CELLS, bool)
    held[wanted.select(cell.alias("cell")).distinct().toArrow()["cell"].to_numpy()] = True
    bits = np.packbits(held)

    def there(cells: pd.Series) -> pd.Series:
        at = cells.to_numpy()
        return pd.Series((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return rows.where(F.pandas_udf(there, "boolean")(cell))
