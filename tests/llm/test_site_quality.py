"""Host and path posteriors of the quality classifier against plain Python, and held-out accuracy."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

from placeweave.llm import site_quality
from tests.llm.test_native import base_counts, words

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, value string, bins string, host_n int"


def bins(text):
    n, chars, symbols, lines, repeats = base_counts(text)
    text = text or ""

    def share(part, whole, steps=10):
        return min(math.floor(steps * part / max(whole, 1)), 2 * steps)

    return (
        math.floor(math.log(n + 1) / math.log(2)), share(symbols, n, 4), share(repeats, n), min(lines, 5),
        min(chars // max(n, 1), 20), share(text.count("!"), n), share(len(re.findall("[A-Z]", text)), chars),
        share(len(set(words(text))), n),
    )


def strength(groups):
    """groups: (n, total, prior)."""
    some = [g for g in groups if g[0] > 1]
    seen = sum(n * (total / n - p) ** 2 for n, total, p in some)
    alone = sum(p * (1 - p) for n, total, p in some)
    rest = sum((n - 1) * p * (1 - p) for n, total, p in some) or 1.0
    return min(max(1 / max((seen - alone) / rest, 1e-4) - 1, 1.0), 1e4)


def expected(rows, labels):
    """(evidence, host_mean, path_mean, score) of each row (key, text, lang, source), in order."""
    known = {}
    for key, label in labels:
        if key is not None and label in (0, 1) and zlib.crc32(str(key).encode()) % 5:
            known[key] = max(label, known.get(key, 0))
    counts = [defaultdict(Counter) for _ in site_quality.FEATURES]
    own = [bins(r[1]) for r in rows]
    taught = [known.get(r[0]) for r in rows]
    for b, label in zip(own, taught):
        if label is not None:
            for f, v in enumerate(b):
                counts[f][v][label] += 1
    good, bad = taught.count(1) + 1, taught.count(0) + 1
    mean = good / (good + bad)
    values, evidences = [], []
    for b, label in zip(own, taught):
        e = 0.0
        for f, v in enumerate(b):
            if v in counts[f]:
                c = counts[f][v]
                e += math.log((c[1] + mean) / good) - math.log((c[0] + 1 - mean) / bad)
        e = max(-site_quality.MOST_EVIDENCE, min(site_quality.MOST_EVIDENCE, e))
        evidences.append(e)
        values.append(float(label) if label is not None else 1 / (1 + math.exp(-(e + math.log(mean / (1 - mean))))))
    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, _, path, host), v in zip(rows, values):
        hosts[host].append(v)
        paths[host, path].append(v)
    by_host = strength([(len(v), sum(v), mean) for v in hosts.values()])
    whole = {h: (sum(v) + by_host * mean) / (len(v) + by_host) for h, v in hosts.items()}
    by_path = strength([(len(v), sum(v), whole[h]) for (h, _), v in paths.items()])
    out = []
    for (_, _, path, host), v, e in zip(rows, values, evidences):
        h, p = hosts[host], paths[host, path]
        host_mean = (sum(h) - v + by_host * mean) / (len(h) - 1 + by_host)
        path_mean = (sum(p) - v + by_path * host_mean) / (len(p) - 1 + by_path)
        sure = min(max(path_mean, 1e-6), 1 - 1e-6)
        out.append((e, host_mean, path_mean, 1 / (1 + math.exp(-(e + math.log(sure / (1 - sure)))))))
    return out


def corpus():
    """Good prose on some hosts, junk on others, both on one; null hosts and paths, repeated rows, null keys, long texts."""
    rows = []
    for i in range(60):
        good = "\n".join(f"line {j} tells of another walk to the river number {i * j}" for j in range(6))
        junk = "BUY NOW ! ! ! # # $$$ " * (i % 7 + 1)
        host = (None, "a", "b", "c", "mixed")[i % 5]
        text = good if host in (None, "a") or (host == "mixed" and i % 2) else junk
        rows.append((i, text, (None, "en", "de")[i % 3], host))
    rows += [(60, None, "en", "a"), (61, "", None, None), (62, "word " * 40_000, "en", "b"), (63, "alone", "fr", "lonely")]
    return rows + [(0, rows[0][1], rows[0][2], rows[0][3]), (None, "no key at all", "en", "a")]


def scored(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "v", "b", 1) for r in rows], SCHEMA)
    return site_quality.site_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, key string"))


def test_posteriors_match_plain_python(spark):
    rows = corpus()
    labels = [(i, int(rows[i][3] in (None, "a") or (rows[i][3] == "mixed" and i % 2 == 1)), "k") for i in range(0, 60, 2)]
    labels += [(1, 0, "k"), (1, 1, "k"), (None, 1, "k"), (5, None, "k"), (7, 9, "k")]
    got = scored(spark, rows, labels).collect()
    want = expected(rows, [x[:2] for x in labels])
    assert len(got) == len(rows)

    def shaped(key, values):
        return (key is None, key or 0, tuple(round(v, 6) for v in values))

    mine = sorted(shaped(r.doc_id, (r.evidence, r.host_mean, r.path_mean, r.score)) for r in got)
    assert mine == sorted(shaped(r[0], v) for r, v in zip(rows, want))
    assert all(r.kept == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)


def test_no_labels_no_documents_and_missing_columns(spark):
    rows = [(1, "one text", "en", "a"), (2, None, None, None)]
    got = scored(spark, rows, []).collect()
    assert [(r.evidence, r.score, r.kept) for r in got] == [(0.0, 0.5, True)] * 2
    assert scored(spark, [], [(1, 1, "k")]).count() == 0
    with pytest.raises(ValueError, match="missing"):
        site_quality.site_quality(spark.range(1), spark.range(1))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_labels_are_met(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").dropna()
    got = site_quality.run(spark, DATA).filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in got) / len(got)
    common = max(sum(r.quality == q for r in got) for q in (0, 1)) / len(got)
    assert right >= 0.95 and right > common
