"""Rows of vector tables, and streams in which blocks of query vectors meet bounded groups of rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows that one task of ``meet`` holds for one key, about; a key with more is cut into parts.
HELD_ROWS = 2**18


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.coalesce(odd, F.lit(True))


def usable(df: DataFrame, key: str, vector: str, *others: str, zeros: bool = True) -> DataFrame:
    """``id``, ``vector`` and the other columns of the rows that take part, one row for each key.

    Rows with a null key, a null in ``others``, or a vector that is null, empty or not finite stay out;
    without ``zeros`` also vectors of nothing but 0. Of several rows of one key the least stays
    (by ``others``, then by components), so repeated rows count once.
    """
    good = F.col(key).isNotNull() & finite(F.col(vector))
    for name in others:
        good = good & F.col(name).isNotNull()
    if not zeros:
        good = good & F.exists(F.col(vector), lambda x: x != 0)
    rows = df.filter(good).select(F.col(key).alias("id"), F.struct(*others, F.col(vector).alias("vector")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


def common_size(df: DataFrame) -> tuple[int, int]:
    """(length, rows) of the vectors of the most frequent length, the least of equally frequent ones; (0, 0) without rows."""
    sizes = df.groupBy(F.size("vector").alias("size")).count()
    found = sizes.orderBy(F.desc("count"), "size").first()
    return (found["size"], found["count"]) if found else (0, 0)


def matrix(column, size: int, kind=np.float64) -> np.ndarray:
    """The vectors of an Arrow list column as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), size)


def first_best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` best: higher scores first, ties by smaller id; an id counts once."""
    order = np.lexsort((ids, -scores))
    if len(np.unique(ids)) < len(ids):
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)]
    return order[:most]


def meet(rows: DataFrame, probes: DataFrame, keys: list[str], order: list[str], tasks: int, hold, answer, schema: str):
    """Every probe meets the rows of its key; rows are held, probes stream past them.

    Both sides are dealt out by ``keys`` in one shuffle and sorted so that the rows of a key come first.
    ``hold(table)`` gets the rows of one key in ``order`` and prepares them, ``answer(held, probe)`` gives an Arrow
    batch or None for each probe, a dict of its columns. A task holds the rows of one key at a time, so callers cut
    keys to about HELD_ROWS. A task that runs again after a lost executor reads the same shuffle again.
    """
    sides = rows.withColumn("kind", F.lit(0)).unionByName(probes.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = sides.repartition(tasks, *keys).sortWithinPartitions(*keys, "kind", *order)

    def run(batches):
        at, parts, held = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "kind")])
            edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for start, stop in zip((0, *edges), (*edges, batch.num_rows)):
                if start == stop:
                    continue
                *key, kind = marks[:, start].tolist()
                if key != at:
                    at, parts, held = key, [], None
                piece = batch.slice(start, stop - start)
                if kind == 0:
                    parts.append(piece)
                elif parts or held is not None:
                    if held is None:
                        held, parts = hold(pa.Table.from_batches(parts)), []
                    for probe in piece.to_pylist():
                        found = answer(held, probe)
                        if found is not None:
                            yield found

    return dealt.mapInArrow(run, schema)
