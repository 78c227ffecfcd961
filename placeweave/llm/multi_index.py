"""Approximate nearest neighbours by an inverted multi-index over two halves of each vector."""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from placeweave.llm.native import fresh, read
from placeweave.llm.store import stored
from placeweave.llm.vectors import HELD_ROWS, common_size, first_best, matrix, meet, usable

NEIGHBOURS = 20
#: Rows (of smallest hash) that fit the centroids, rounds of k-means, rows per cell that set the number of centroids.
FIT_ROWS, ROUNDS, CELL_ROWS, MOST_CENTROIDS = 20_000, 8, 32, 512
#: Queries (of smallest hash) that are answered exactly to set the length of the lists, and the share to be found.
TRIAL_QUERIES, RECALL = 256, 0.96
#: Rows compared at once, queries that travel together.
BLOCK_ROWS, QUERIES = 4096, 256


def k_means(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the points: evenly spaced starts, ROUNDS of Lloyd; an empty centroid stays where it was."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest_centre(points, centres)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(axis=0)
    return centres


def nearest_centre(points, centres):
    return (points @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)


class Index:
    """Centroids of both halves and the number of entries of each pair of centroids."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = (sample.shape[1] + 1) // 2
        self.first, self.second = k_means(sample[:, : self.half], k), k_means(sample[:, self.half :], k)
        self.sizes = np.zeros((k, k), np.int64)

    def cells(self, vectors):
        return nearest_centre(vectors[:, : self.half], self.first), nearest_centre(vectors[:, self.half :], self.second)

    def distances(self, queries):
        """Of every query to the centroids of each half: the inner product, negated. Their sum ranks the pairs."""
        return -(queries[:, : self.half] @ self.first.T), -(queries[:, self.half :] @ self.second.T)

    def steps(self, queries, most: int):
        """(K steps per query, ranks): how many of its nearest second centroids a query visits with each first one.

        Pairs leave a heap by summed distance until their entries reach ``most``. One pair per opened first
        centroid waits in the heap: the next for the same one, and the first of the next.
        """
        one, two = self.distances(queries)
        order_one, order_two = one.argsort(axis=1, kind="stable"), two.argsort(axis=1, kind="stable")
        out = np.zeros(one.shape, np.uint16)
        k = one.shape[1]
        for q in range(len(queries)):
            a, b = one[q, order_one[q]].tolist(), two[q, order_two[q]].tolist()
            sizes = self.sizes[np.ix_(order_one[q], order_two[q])].tolist()
            heap, seen, found = [(a[0] + b[0], 0, 0)], [0] * k, 0
            while heap and found < most:
                _, i, j = heap[0]
                found += sizes[i][j]
                seen[i] = j + 1
                if j + 1 < k:
                    heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
                else:
                    heapq.heappop(heap)
                if j == 0 and i + 1 < k:
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            out[q, order_one[q]] = seen
        return out, order_two.argsort(axis=1, kind="stable")

    def share_ahead(self, query, first, second):
        """For cells (first, second): the share of all entries in cells that are no farther from the query."""
        one, two = self.distances(query[None, :])
        sums = one[0][:, None] + two[0][None, :]
        flat = sums.ravel().argsort(kind="stable")
        reached = np.cumsum(self.sizes.ravel()[flat])
        at = np.searchsorted(sums.ravel()[flat], sums[first, second], side="right") - 1
        return reached[at] / max(1, reached[-1])


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed alike for every row, wherever it stands, so that equal vectors tie."""
    return (rows * query).sum(axis=1)


def best_of(products, rows, ids, queries, query_ids, most):
    """(query number, id, score) of the best ``most`` of each query; products of -inf were not visited."""
    width = products.shape[1]
    if width > most + 1:
        edge = np.partition(products, width - most - 1, axis=1)[:, width - most - 1]
    else:
        edge = np.full(len(products), -np.inf)
    slack = 1e-9 * (1 + np.abs(edge, where=np.isfinite(edge), out=np.zeros(len(edge))))
    for q in range(len(products)):
        at = np.flatnonzero((products[q] >= edge[q] - slack[q]) & (products[q] > -np.inf) & (ids != query_ids[q]))
        if len(at):
            scores = exact(rows[at], queries[q])
            chosen = first_best(scores, ids[at], most)
            yield q, ids[at][chosen], scores[chosen]


def as_batch(found, query_ids):
    """Arrow rows query_id, id, score."""
    found = list(found)
    if not found:
        return None
    counts = [len(ids) for _, ids, _ in found]
    owner = np.repeat([query_ids[q] for q, _, _ in found], counts).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(owner), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))],
        names=["query_id", "id", "score"],
    )


def ranked(found: DataFrame, most: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def built(rows: DataFrame, size: int, n: int) -> tuple[Index, DataFrame]:
    """The index, and the stored entries: id, vector and cell (one, two) of every row."""
    k = int(min(MOST_CENTROIDS, max(1, round((n / CELL_ROWS) ** 0.5))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(FIT_ROWS, k)).select("vector").toArrow()
    sample = matrix(sample.column("vector"), size)
    index = Index(sample, min(k, len(sample)))

    def assign(batches):
        for batch in batches:
            one, two = index.cells(matrix(batch.column("vector"), size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32))],
                names=["id", "vector", "one", "two"],
            )

    kind = dict(rows.dtypes)["vector"]
    entries = stored(rows.select("id", "vector").mapInArrow(assign, f"id bigint, vector {kind}, one int, two int"), "entries")
    for r in entries.groupBy("one", "two").count().collect():  # at most MOST_CENTROIDS squared
        index.sizes[r["one"], r["two"]] = r["count"]
    return index, entries


def list_share(index: Index, entries: DataFrame, queries: DataFrame, size: int, most: int, recall: float) -> float:
    """The least share of all entries whose lists hold ``recall`` of the exact neighbours of the trial queries."""
    trial = queries.orderBy(F.xxhash64("id"), "id").limit(TRIAL_QUERIES).toArrow()
    if not len(trial):
        return 1.0
    vectors, query_ids = matrix(trial.column("vector"), size), trial.column("id").to_numpy()

    def search(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(start, BLOCK_ROWS)
                rows, ids = matrix(some.column("vector"), size), some.column("id").to_numpy()
                found = as_batch(best_of(vectors @ rows.T, rows, ids, vectors, query_ids, most), query_ids)
                if found is not None:
                    yield found

    found = ranked(entries.mapInArrow(search, "query_id bigint, id bigint, score double"), most)
    found = entries.join(F.broadcast(found), "id").select("query_id", "one", "two").toPandas()  # TRIAL_QUERIES times ``most``
    if not len(found):
        return 1.0
    place = {q: i for i, q in enumerate(query_ids.tolist())}
    shares = [
        index.share_ahead(vectors[place[q]], own["one"].to_numpy(), own["two"].to_numpy())
        for q, own in found.groupby("query_id")
    ]
    return float(np.quantile(np.concatenate(shares), recall, method="higher"))


def neighbours(
    df: DataFrame, is_query, key="vec_id", vector="embedding", most: int = NEIGHBOURS, recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, id and score: the ``most`` nearest rows found of every query, by largest inner product.

    ``is_query`` is a condition on the column ``id``. Both halves of the vectors have centroids of their own; an entry
    stands in the list of its pair of centroids. A query takes pairs off a heap by summed distance (the inner product
    with the centroids, negated) until the lists hold a share of all entries, and every entry of these lists is compared
    by its whole vector in double precision. The share is measured, not given: that at which
    ``recall`` of the exact neighbours of TRIAL_QUERIES queries are in the lists. Centroids are fitted to FIT_ROWS rows;
    every row is indexed.

    Rows with a null id, or a vector that is null, empty, zero or not finite take no part; nor do vectors whose length
    is not the most frequent one. Rows of one id count once (the least). Ties go to the smaller id. A query with fewer
    candidates gets all that are found; an empty table gives no rows. Other columns are ignored.
    """
    fresh(df, key, vector)
    rows = usable(df.select(F.col(key).cast("bigint").alias(key), vector), key, vector, zeros=False)
    rows = stored(rows, "vectors")
    size, n = common_size(rows)
    if not n:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    rows = rows.filter(F.size("vector") == size)
    index, entries = built(rows, size, n)
    queries = rows.filter(is_query)
    share = list_share(index, entries, queries, size, most, recall)
    length = min(n, max(int(np.ceil(share * n)), most + 1))
    cores = df.sparkSession.sparkContext.defaultParallelism
    k = len(index.first)
    # A shard holds the lists of neighbouring first centroids; a large one is cut into parts.
    shards = max(1, min(k, -(-n // BLOCK_ROWS), max(2 * cores, -(-n // HELD_ROWS))))
    shard_of = np.arange(k) * shards // k
    parts_of = [int(max(1, -(-index.sizes[shard_of == s].sum() // HELD_ROWS))) for s in range(shards)]
    part_counts = F.array(*[F.lit(p) for p in parts_of])
    dealt = entries.withColumn("shard", (F.col("one") * shards / k).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.element_at(part_counts, F.col("shard") + 1)).cast("int")
    )

    def visits(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES):
                some = batch.slice(start, QUERIES)
                vectors, ids = matrix(some.column("vector"), size), some.column("id").to_numpy()
                steps, ranks = index.steps(vectors, length)
                for s in range(shards):
                    own = steps[:, shard_of == s]
                    at = np.flatnonzero(own.any(axis=1))
                    if len(at):
                        cells = [ids[at].tobytes(), vectors[at].tobytes(), own[at].tobytes(), ranks[at].astype(np.uint16).tobytes()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([s], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)],
                            names=["shard", "ids", "vectors", "steps", "ranks"],
                        )

    probes = queries.select("id", "vector").repartition(cores, "id")
    probes = probes.mapInArrow(visits, "shard int, ids binary, vectors binary, steps binary, ranks binary")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(part_counts, F.col("shard") + 1) - 1)))

    def hold(table):
        ids = table.column("id").to_numpy()
        one, two = (table.column(c).to_numpy() for c in ("one", "two"))
        return ids, matrix(table.column("vector"), size), one, two, int(table.column("shard")[0].as_py())

    def rerank(held, probe):
        ids, rows, one, two, shard = held
        query_ids = np.frombuffer(probe["ids"], np.int64)
        vectors = np.frombuffer(probe["vectors"], np.float64).reshape(len(query_ids), size)
        steps = np.frombuffer(probe["steps"], np.uint16).reshape(len(query_ids), -1)
        ranks = np.frombuffer(probe["ranks"], np.uint16).reshape(len(query_ids), k)
        begin = int(np.flatnonzero(shard_of == shard)[0])
        best = {}
        for start in range(0, len(ids), BLOCK_ROWS):
            own = slice(start, start + BLOCK_ROWS)
            products = np.full((len(query_ids), len(ids[own])), -np.inf)
            cells = one[own].astype(np.int64) * k + two[own]
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for i, j in zip(edges, edges[1:]):
                visitors = np.flatnonzero(ranks[:, two[start + i]] < steps[:, one[start + i] - begin])
                if len(visitors):
                    products[visitors, i:j] = vectors[visitors] @ rows[start + i : start + j].T
            for q, found, scores in best_of(products, rows[own], ids[own], vectors, query_ids, most):
                if q in best:
                    found, scores = np.concatenate([best[q][0], found]), np.concatenate([best[q][1], scores])
                    chosen = first_best(scores, found, most)
                    found, scores = found[chosen], scores[chosen]
                best[q] = (found, scores)
        return as_batch(((q, *x) for q, x in best.items()), query_ids)

    tasks = 2 * max(sum(parts_of), cores)
    found = meet(dealt, probes, ["shard", "part"], ["one", "two", "id"], tasks, hold, rerank, "query_id bigint, id bigint, score double")
    return ranked(found, most).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def run(spark, sf_dir):
    """Queries are the rows whose id 20 divides."""
    return neighbours(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")
