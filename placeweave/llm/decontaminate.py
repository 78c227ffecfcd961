"""Benchmark decontamination by winnowed fingerprints, extended to exact shared windows."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from placeweave.llm.buffers import ALNUM, Words, grams, owners, slices
from placeweave.llm.native import fresh, read
from placeweave.llm.store import stored

WINDOW = 10
GRAM = 5
#: A minimum is kept of each so many neighbouring grams, so any ten shared words share a kept gram.
GUARD = WINDOW - GRAM + 1
#: Size of the broadcast filters in bits, whatever the benchmark holds: 8 MB each.
FILTER_BITS = 2**26


def winnowed(prints, first):
    """Places of the (rightmost) least gram hash in every run of GUARD grams that lies in one text."""
    n = len(prints)
    most = n - GUARD + 1
    if most <= 0:
        return np.zeros(0, np.int64)
    best, at = prints[:most].copy(), np.zeros(most, np.int64)
    for j in range(1, GUARD):
        now = prints[j : j + most]
        better = now <= best
        best = np.where(better, now, best)
        at[better] = j
    word = np.arange(most)
    inside = owners(first, first[-1])
    ends = first[1:][inside[:most]]
    return np.unique((word + at)[word + WINDOW <= ends])


def benchmark_rows(batches):
    """(item, window words, bit, is short): every window of an item, and the filter bits of its fingerprints."""
    schema = pa.schema([("item", pa.int64()), ("window", pa.string()), ("size", pa.int32()), ("bit", pa.int64())])
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), ALNUM)
        hashes = words.hashes()
        prints = grams(hashes, GRAM)
        kept = winnowed(prints, words.first)
        rows = []
        for i, item in enumerate(batch.column("item").to_pylist()):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= WINDOW:
                rows += [(item, words.text(s, WINDOW), WINDOW, None) for s in range(a, b - WINDOW + 1)]
                for p in kept[np.searchsorted(kept, a) : np.searchsorted(kept, b)]:
                    rows.append((item, None, WINDOW, int(prints[p] % np.uint64(FILTER_BITS))))
            elif b > a:
                bit = int(grams(hashes[a:b], b - a)[0] % np.uint64(FILTER_BITS))
                rows += [(item, words.text(a, b - a), b - a, None), (item, None, b - a, bit)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, schema.types)], schema=schema
        )


def filter_of(bits: DataFrame) -> bytes:
    """The set bits as one bitmap: Spark builds 4 KB pieces, at most FILTER_BITS in all reach the driver."""
    pieces = (
        bits.select((F.col("bit") + 1).alias("bit"))  # these functions number bits from 1
        .groupBy(F.bitmap_bucket_number("bit").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    whole = bytearray(FILTER_BITS // 8)
    for piece, part in pieces:
        at = (piece - 1) * len(part)
        for i, byte in enumerate(part):
            if byte and at + i < len(whole):
                whole[at + i] |= byte
    return bytes(whole)


def candidate_rows(long_bits, short_bits, short_sizes):
    """Function over batches (key, text): one row per text, or one per place where a window may stand."""

    def has(filter_bits, hashes):
        bit = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
        return (filter_bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

    def run(batches):
        long_filter = np.frombuffer(long_bits.value, np.uint8)
        short_filter = np.frombuffer(short_bits.value, np.uint8)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), ALNUM)
            first, n = words.first, len(words.start)
            hashes, inside = words.hashes(), owners(words.first, len(words.start))
            places, sizes = [], []
            if n:
                prints = grams(hashes, GRAM)
                kept = winnowed(prints, first)
                if len(kept):
                    kept = kept[has(long_filter, prints[kept])]
                # Every window that holds the fingerprint: the hit extended to both sides.
                starts = (kept[:, None] + np.arange(GRAM - WINDOW, 1)[None, :]).ravel()
                starts = np.unique(starts[starts >= 0])
                ends = np.minimum(starts + WINDOW, n) - 1
                whole = (starts + WINDOW <= n) & (inside[starts] == inside[ends])
                places.append(starts[whole])
                sizes.append(np.full(int(whole.sum()), WINDOW))
                for size in short_sizes:
                    short = grams(hashes, size)
                    at = np.flatnonzero(has(short_filter, short))
                    at = at[inside[at] == inside[at + size - 1]]
                    places.append(at)
                    sizes.append(np.full(len(at), size))
            places = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
            sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
            owner = inside[places] if len(places) else places
            bare = np.setdiff1d(np.arange(batch.num_rows), owner)
            take = np.concatenate([owner, bare])
            blank = [None] * len(bare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(take + row, pa.int64()),
                    batch.column("key").take(pa.array(take, pa.int64())),
                    pa.array(words.counts[take], pa.int64()),
                    pa.array([*(places - first[owner]).tolist(), *blank], pa.int64()),
                    pa.array([*sizes.tolist(), *blank], pa.int64()),
                    pa.array([*map(words.text, places.tolist(), sizes.tolist()), *blank], pa.string()),
                ],
                names=["row", "key", "n_words", "at", "size", "window"],
            )
            row += batch.num_rows

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, key="doc_id", text="text", item="item_id", item_text="text"
) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items (sorted as text), items_sha256, contaminated.

    Words are lower-cased runs of a-z, 0-9 and characters beyond ASCII. A window is ten consecutive words
    of an item; an item of one to nine words is one window. Words inside an occurrence of a window are hit.

    Fingerprints (least 5-gram hash of each six) of documents are looked up in a filter of fixed size made
    from those of the benchmark; each hit is extended to the windows that hold it, which join the
    benchmark's windows by their words, so hash collisions never count. Windows of whole short items are
    looked up by their own hash in a second filter.

    Null and empty texts have no words and no hits; null item texts no windows; a null item_id counts as no
    item, its windows still hit. Every input row gives one output row, repeated rows too. An empty benchmark
    hits nothing. Other columns are ignored.
    """
    fresh(docs, key, text)
    fresh(benchmark, item, item_text)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text"))
    made = stored(
        items.mapInArrow(benchmark_rows, "item bigint, window string, size int, bit bigint"), "windows"
    )
    bits = made.filter("bit is not null")
    windows = (
        made.filter("window is not null").groupBy("window")
        .agg(F.collect_set("item").alias("items"), F.lit(True).alias("known"))  # as many items as the benchmark has
    )
    short_sizes = [r[0] for r in bits.filter(F.col("size") < WINDOW).select("size").distinct().collect()]
    sent = [
        spark.sparkContext.broadcast(filter_of(bits.filter(which).select("bit")))
        for which in (F.col("size") == WINDOW, F.col("size") < WINDOW)
    ]
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        candidate_rows(*sent, short_sizes),
        f"row bigint, key {kind}, n_words bigint, at bigint, size bigint, window string",
    )
    # Texts without a candidate get a key of their own, else they would meet in one task.
    found = found.withColumn("window", F.coalesce("window", F.concat(F.lit("\n"), F.col("row").cast("string"))))
    met = found.join(windows, "window", "left")
    per_doc = met.groupBy("row").agg(
        F.first("key").alias(key), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("known"), F.struct("at", (F.col("at") + F.col("size")).alias("stop"))))).alias("hits"),
        F.collect_set("items").alias("items"),
    )
    union = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("bigint").alias("stop"), F.lit(0).cast("bigint").alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["stop"], h["stop"]).alias("stop"),
            (a["n"] + F.greatest(F.lit(0), h["stop"] - F.greatest(a["stop"], h["at"]))).alias("n"),
        ),
    )["n"]
    names = F.sort_array(F.transform(F.array_distinct(F.flatten("items")), lambda i: i.cast("string")))
    out = per_doc.select(key, "n_words", union.alias("n_hit"), names.alias("items"))
    return out.select(
        key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, key="doc_id", text="text") -> DataFrame:
    """The documents of which no word is hit, all columns as they were.

    Rows are matched by their key and a hash of their text, so rows that share a key are judged apart.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct(F.col(key).alias("key"), digest.alias("digest")).alias("id"), F.col(text).alias("body"))
    bad = contamination(rows, benchmark, "id", "body").filter("contaminated").select("id.*").distinct()
    bad = stored(bad.select(F.col("key").alias("bad_key"), F.col("digest").alias("bad_digest")), "leaks")
    same = docs[key].eqNullSafe(bad["bad_key"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["bad_digest"])
    return docs.join(bad, same, "left_anti")


def run(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")
