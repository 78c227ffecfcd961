"""Hard negatives and the inverted multi-index against plain numpy on small, awkward inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeweave.llm import hard_negatives, multi_index

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, vector int, grp int, side int, kind int, row int, one string, rank int"
BAD = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0]]


def table(spark, rows):
    """Rows (id, vector, label) beside columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, v, label, "x", 1, 1, 1, 1, 1, "y", 1) for i, v, label in rows], SCHEMA)


def clean(rows, size, zeros=True):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or len(v) != size or any(x is None or not np.isfinite(x) for x in v):
            continue
        if not zeros and not any(v):
            continue
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    return sorted((i, v, label) for i, (label, v) in kept.items())


def plain_negatives(rows, every, positives=5, negatives=3):
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows}
    label, out = {i: x for i, _, x in rows}, []
    for a in whole:
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(whole[a], v)) for i, v in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:positives]:
            fits = [i for i in order if label[i] != label[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fits[:negatives])]
    return sorted(out)


def found_negatives(df, every):
    got = hard_negatives.hard_negatives(df, F.col("id") % every == 0)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def some_rows(n, size, seed, labels=3, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0.2, 0.4, size).round(2).tolist(), int(rng.integers(labels))) for i in range(n)]
    return rows + [(n + i, rows[0][1], rows[i % n][2]) for i in range(copies)]


@pytest.mark.parametrize("seed,size", [(1, 5), (2, 40)])
def test_hard_negatives_match_all_pairs(spark, monkeypatch, seed, size):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "STEP", 3)
    rows = some_rows(150, size, seed, copies=30)
    rows += rows[:20] + [(None, rows[0][1], 1), (500, rows[0][1], None), (510, [0.0] * size, 1)]
    rows += [(600 + i, v, 1) for i, v in enumerate(BAD)]
    assert found_negatives(table(spark, rows), 10) == plain_negatives(clean(rows, size), 10)


def test_hard_negatives_of_large_components_and_equal_vectors(spark):
    rows = [(i, [1e9 + 3e7 * (i % 7), -5e8, float(i % 3)], i % 2) for i in range(40)]
    expected = [x for x in plain_negatives(rows, 5) if abs(x[4]) < 2**63]
    got = found_negatives(table(spark, rows), 5)
    assert [x[:4] for x in got] == [x[:4] for x in plain_negatives(rows, 5)]
    assert [x for x in got if abs(x[4]) < 2**63 - 1] == expected
    same = [(i, [0.5, 0.5], i % 2) for i in range(30)] + [(100 + i, [0.4, 0.5], i % 2) for i in range(9)]
    assert found_negatives(table(spark, same), 10) == plain_negatives(same, 10)


def test_hard_negatives_of_nothing(spark):
    assert found_negatives(table(spark, []), 5) == []
    assert found_negatives(table(spark, [(5, [1.0], 1)]), 5) == []
    assert found_negatives(table(spark, [(5, None, 1), (10, [float("nan")], 2)]), 5) == []


def test_scan_prunes_without_touching_results():
    rng = np.random.default_rng(3)
    values = np.floor(rng.normal(0, 30, (500, 32)))
    block = hard_negatives.Block(np.arange(500), np.zeros(500, int), values)
    anchor, left = np.floor(rng.normal(0, 30, 32)), []

    def useful(low, high):
        keep = high >= hard_negatives.kth(low, 5)
        left.append(int(keep.sum()))
        return keep

    at, scores = hard_negatives.scan(block, anchor, np.ones(500, bool), useful)
    exact = values @ anchor
    assert set(np.argsort(-exact)[:5]) <= set(at) and np.array_equal(scores, exact[at])


def plain_neighbours(rows, every, most):
    ids = np.array([i for i, _, _ in rows])
    vectors = np.array([v for _, v, _ in rows])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = (vectors * vectors[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:most]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def found_neighbours(df, every, most, recall):
    out = {}
    for r in multi_index.neighbours(df, F.col("id") % every == 0, most=most, recall=recall).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_are_exact_where_every_query_is_a_trial(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 64)
    rows = some_rows(400, 7, 4, copies=60)
    rows += rows[:30] + [(None, rows[0][1], 1), (1000, [0.0] * 7, 1)] + [(1100 + 20 * i, v, 1) for i, v in enumerate(BAD)]
    rows += [(2000, rows[5][1], None)]
    labelled = [(i, v, 0 if label is None else label) for i, v, label in rows]
    expected = plain_neighbours(clean(labelled, 7, zeros=False), 20, 6)
    got = found_neighbours(table(spark, rows), 20, 6, 1.0)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in expected.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], expected[q]))


def test_recall_of_lists_set_on_other_queries(spark, monkeypatch):
    """A third of all rows are near copies of one vector; the trial sees a fifth of the queries."""
    monkeypatch.setattr(multi_index, "TRIAL_QUERIES", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (60, 24))
    vectors = centres[rng.integers(60, size=4000)] + rng.normal(0, 0.5, (4000, 24))
    vectors[:1300] = centres[0] + rng.normal(0, 0.01, (1300, 24))
    vectors[::7] *= rng.uniform(0.3, 3, (len(vectors[::7]), 1))
    order = rng.permutation(4000)
    rows = [(int(i), vectors[j].tolist(), 1) for i, j in enumerate(order)]
    expected, got = plain_neighbours(rows, 20, 20), found_neighbours(table(spark, rows), 20, 20, multi_index.RECALL)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in x}) for q, x in expected.items())
    assert hits / (20 * len(expected)) >= 0.9


def test_few_rows_have_few_neighbours(spark):
    assert found_neighbours(table(spark, []), 20, 5, 1.0) == {}
    assert found_neighbours(table(spark, [(20, [1.0], 1)]), 20, 5, 1.0) == {}
    got = found_neighbours(table(spark, [(20, [1.0], 1), (40, [2.0], None), (41, [2.0], 2)]), 20, 5, 1.0)
    assert got == {20: [(40, 2.0), (41, 2.0)], 40: [(41, 4.0), (20, 2.0)]}


def test_heap_visits_pairs_by_summed_distance():
    rng = np.random.default_rng(6)
    index = multi_index.Index(rng.normal(0, 1, (200, 8)), 6)
    index.sizes = rng.integers(0, 9, (6, 6))
    queries = rng.normal(0, 1, (20, 8))
    steps, ranks = index.steps(queries, 60)
    one, two = index.distances(queries)
    for q in range(20):
        sums = one[q][:, None] + two[q][None, :]
        visited = ranks[q][None, :] < steps[q][:, None]
        assert index.sizes[visited].sum() >= 60
        farthest = sums[visited].max()
        assert np.array_equal(visited, sums <= farthest)
        assert index.sizes[sums < farthest].sum() < 60
