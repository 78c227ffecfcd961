"""Near-duplicate classes: consistent weighted samples of TF-IDF shingles, banded, verified exactly."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placeweave.llm.buffers import ODD, SOLID, Words, grams, mixed, slices
from placeweave.llm.decontaminate import FILTER_BITS, filter_of
from placeweave.llm.native import fresh, read
from placeweave.llm.store import removed, stored
from placeweave.operators.skew import split_join

SHINGLE = 5
SIMILAR = 0.8
#: 16 bands of 4 samples find a pair of similarity 0.8 with probability 0.9998, and one of 0.3 seldom.
BANDS, ROWS = 16, 4
#: Document frequencies are kept per hash bucket, a table of fixed size however large the corpus is.
BUCKETS = 2**16
TABLE = 2**16


class Shingles:
    """Distinct five-word shingles of every text: ``hashes`` (ascending per text), ``counts``, ``first`` of each text.

    A text of one to four words is one shingle. ``nodes`` are 16-byte digests of the word sequence.
    """

    def __init__(self, column):
        words = Words(column, SOLID)
        own = words.hashes()
        first, sizes = words.first, words.counts
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        prints = grams(own, SHINGLE)
        places = np.flatnonzero(np.arange(len(prints)) + SHINGLE <= first[1:][owner[: len(prints)]])
        hashes, owners = prints[places], owner[places]
        short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
        if len(short):
            extra = np.array([grams(own[first[i] : first[i + 1]], sizes[i])[0] for i in short], np.uint64)
            hashes, owners = np.concatenate([hashes, extra]), np.concatenate([owners, short])
        order = np.lexsort((hashes, owners))
        hashes, owners = hashes[order], owners[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        at = np.flatnonzero(new)
        self.hashes, self.owner = hashes[at], owners[at]
        self.counts = np.diff(np.append(at, len(hashes)))
        self.first = np.searchsorted(self.owner, np.arange(n + 1))
        self.sizes = sizes
        place = np.arange(len(own), dtype=np.uint64) - np.repeat(first[:-1], sizes).astype(np.uint64)
        halves = []
        for seed in (1, 2):
            sums = np.cumsum(mixed(own + (place * np.uint64(2) + np.uint64(seed)) * ODD), dtype=np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), sums])
            halves.append(mixed(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64)))
        both = np.stack(halves, axis=1).astype("<u8")
        self.nodes = [both[i].tobytes() if sizes[i] else None for i in range(n)]


def bucket_of(hashes):
    return (hashes >> np.uint64(48)).astype(np.int64)


def bucket_counts(batches):
    """(bucket, documents) of one part of the corpus; bucket -1 counts all documents."""
    counts, n = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches, "text"):
        s = Shingles(batch.column("text"))
        bucket = bucket_of(s.hashes)
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (s.owner[1:] != s.owner[:-1])
        counts += np.bincount(bucket[new], minlength=BUCKETS)
        n += batch.num_rows
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(counts[some], n), pa.int64())],
        names=["bucket", "n"],
    )


def shingle_weights(docs: DataFrame, text="text") -> np.ndarray:
    """Inverse document frequency of each bucket, scaled to 1 (in all documents) to 2 (in none).

    The scale keeps a shingle's weight within a factor of two, so that copies in a very large group, whose
    shared shingles are frequent, stay similar in spite of a few edits.
    """
    rows = docs.select(F.col(text).alias("text")).mapInArrow(bucket_counts, "bucket int, n bigint")
    table = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS + 1 rows
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    counts = np.zeros(BUCKETS)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    total = max(1.0, float(n[bucket < 0].sum()))
    return (1 + np.log((total + 1) / (counts + 1)) / np.log(total + 2)).astype(np.float32)


def seed(i):
    return np.uint64(i * int(ODD) % 2**64)


def random_tables():
    """Gamma(2, 1) twice and uniform values, to be looked up by parts of a hash."""
    draw = np.random.Generator(np.random.PCG64(20))
    gamma = lambda: draw.gamma(2.0, 1.0, TABLE).astype(np.float32)
    return gamma(), np.log(gamma()), draw.random(TABLE, np.float32)


def band_keys(shingles, weights):
    """BANDS keys per text with words: hashes of ROWS consistent weighted samples each (improved CWS)."""
    r_table, c_table, b_table = random_tables()
    some = np.flatnonzero(np.diff(shingles.first))
    keys = np.zeros((len(some), BANDS), np.uint64)
    if not len(some):
        return some, keys
    starts, h, owner = shingles.first[some], shingles.hashes, shingles.owner
    place = np.zeros(len(shingles.sizes), np.int64)
    place[some] = np.arange(len(some))
    log_weight = np.log(weights[bucket_of(h)] * shingles.counts.astype(np.float32))
    low = np.uint64(TABLE - 1)
    for k in range(BANDS * ROWS):
        x = mixed(h + seed(k + 1))
        r = r_table[x & low]
        beta = b_table[(x >> np.uint64(16)) & low]
        t = np.floor(log_weight / r + beta)
        log_a = c_table[(x >> np.uint64(32)) & low] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, starts)
        hits = np.flatnonzero(log_a == least[place[owner]])
        _, firsts = np.unique(owner[hits], return_index=True)
        at = hits[firsts]
        sample = mixed(h[at] + t[at].astype(np.int64).astype(np.uint64) * ODD)
        band = k // ROWS
        keys[:, band] = mixed(keys[:, band] + sample + seed(band + 1))
    return some, keys


def signed(weights):
    def run(batches):
        table = weights.value
        for batch in slices(batches, "text"):
            s = Shingles(batch.column("text"))
            some, keys = band_keys(s, table)
            bands = [None] * batch.num_rows
            for i, row in zip(some.tolist(), keys.astype(np.int64)):
                bands[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(s.nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["key", "node", "bands"],
            )

    return run


def shingles_of(wanted, weights):
    """Function over batches (text): node, hashes and weights of the texts that may be wanted, each once a task."""

    def run(batches):
        table = weights.value
        bits = np.frombuffer(wanted.value, np.uint8)
        seen = set()  # at most the distinct texts of one task's input, 16 bytes each
        for batch in slices(batches, "text"):
            s = Shingles(batch.column("text"))
            bit = np.array([int.from_bytes(n[:4], "big") if n else 0 for n in s.nodes], np.int64) % FILTER_BITS
            take = []
            for i in np.flatnonzero(((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1) > 0).tolist():
                if s.nodes[i] is not None and s.nodes[i] not in seen:
                    seen.add(s.nodes[i])
                    take.append(i)
            cut = [slice(s.first[i], s.first[i + 1]) for i in take]
            weight = table[bucket_of(s.hashes)] * s.counts.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s.nodes[i] for i in take], pa.binary()),
                    pa.array([s.hashes[c].astype(np.int64) for c in cut], pa.list_(pa.int64())),
                    pa.array([weight[c] for c in cut], pa.list_(pa.float32())),
                ],
                names=["node", "hashes", "weights"],
            )

    return run


def similarity(batches):
    """(a, b, similarity) of rows of pairs with their hashes and weights: weighted Jaccard."""
    for batch in batches:
        columns = [batch.column(c) for c in ("hashes_a", "weights_a", "hashes_b", "weights_b")]
        out = []
        for i in range(batch.num_rows):
            ha, wa, hb, wb = (c[i].values.to_numpy() for c in columns)
            wa, wb = wa.astype(float), wb.astype(float)
            _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
            shared = np.minimum(wa[x], wb[y]).sum()
            out.append(float(shared / (wa.sum() + wb.sum() - shared)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"]
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of every node of the edges (a, b): the least node it is connected to.

    Each round takes the least class among neighbours, then the class of that class; rounds grow with the
    logarithm of the longest chain. Every round is written to the shared folder.
    """
    both = stored(  # read in every round
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("class")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("class").alias("near")
        )
        now = labels.join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        up = labels.select(F.col("node").alias("class"), F.col("class").alias("above"))
        after = stored(
            now.join(up, "class").select("node", "old", F.least("class", "above").alias("class")), "labels"
        )
        removed(labels)
        labels = after
        if labels.filter(F.col("old") != F.col("class")).isEmpty():
            removed(both)
            return labels.drop("old")


def node_shingles(rows: DataFrame, nodes: DataFrame, weights) -> DataFrame:
    """node, hashes and weights of the given nodes, read again from the texts; copies leave a task once."""
    spark = rows.sparkSession
    front = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("bigint")
    bits = filter_of(nodes.select((front % FILTER_BITS).alias("bit")).distinct())
    found = rows.select("text").mapInArrow(
        shingles_of(spark.sparkContext.broadcast(bits), weights),
        "node binary, hashes array<bigint>, weights array<float>",
    )
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.first("hashes").alias("hashes"), F.first("weights").alias("weights")
    )


def linkable(shingles: DataFrame, similar: float, rounds: int = 2) -> DataFrame:
    """(node, whole, common) of the nodes that may have a link: their weight, and that of shingles which others hold too.

    What a text shares with another is at most ``common``, so a similarity of ``similar`` needs
    common >= similar * whole. Dropping the others makes more shingles single, hence a second round.
    A shingle that one node alone holds names it by itself, so one grouping by shingle is enough and nothing
    joins back; a shingle that all nodes hold is one row for each task.
    """
    # A 64-bit name is enough here: nodes that fall together only seem to have more in common, as what
    # they hold alone is taken from the weight of both.
    name = F.xxhash64("node").alias("name")
    each = shingles.select(name, F.explode(F.arrays_zip("hashes", "weights")).alias("s"))
    each = each.select("name", F.col("s.hashes").alias("hash"), F.col("s.weights").alias("weight"))
    sums = shingles.select(
        "node", name, F.aggregate("weights", F.lit(0.0), lambda a, w: a + w.cast("double")).alias("whole")
    )
    kept = None
    for _ in range(rounds):
        now = each if kept is None else each.join(kept.select("name"), "name", "left_semi")
        alone = (
            now.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.min("weight").alias("weight"))
            .filter("n = 1").groupBy("name").agg(F.sum(F.col("weight").cast("double")).alias("alone"))
        )
        before = sums if kept is None else kept.select("node", "name", "whole")
        mass = before.groupBy("name").agg(F.sum("whole").alias("mass"))
        common = mass.join(alone, "name", "left").select(
            "name", (F.col("mass") - F.coalesce("alone", F.lit(0.0))).alias("common")
        )
        last, kept = kept, stored(
            before.join(common, "name").filter(F.col("common") >= F.col("whole") * (similar - 1e-6)), "linkable"
        )
        removed(last)
    return kept.drop("name")


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes."""
    for side in "ab":
        pairs = pairs.join(
            shingles.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in shingles.columns]), side
        )
    columns = ["a", "b", "hashes_a", "weights_a", "hashes_b", "weights_b"]
    return pairs.select(*columns).mapInArrow(similarity, "a binary, b binary, similarity double")


def near_classes(docs: DataFrame, key="doc_id", text="text", similar: float = SIMILAR) -> DataFrame:
    """key, node (digest of the words; null without words) and class (digest of the class; null without words).

    Words are runs between ASCII white space, A-Z in lower case. Texts with equal words are one node. Nodes
    with a band in common are candidates; those with a weighted Jaccard similarity of at least ``similar`` are
    linked, and linked nodes make a class.

    A band that many nodes share is not expanded into pairs. Nodes whose shingles are too much their own to
    have any link leave first. The most central node of a band is compared with all others. Where a band is
    not in one class after that, further pairs are compared, but only those that may be linked by the weights of
    the two nodes, by the part of them that others hold too, and by their distances to the central node
    (1 - similarity obeys the triangle inequality). No link between candidates is lost.
    """
    fresh(docs, key, text)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    weights = spark.sparkContext.broadcast(shingle_weights(docs, text))
    signs = stored(rows.mapInArrow(signed(weights), f"key {kind}, node binary, bands array<bigint>"), "signatures")
    texts = stored(signs.filter("node is not null").groupBy("node").agg(F.first("bands").alias("bands")), "texts")
    each = texts.select("node", F.explode("bands").alias("band"))

    def in_company(members):
        return members.join(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "band")

    met = stored(in_company(each), "members")
    read_all = stored(node_shingles(rows, met.select("node").distinct(), weights), "shingles")
    able = linkable(read_all, similar)
    shingles = stored(read_all.join(able.select("node"), "node", "left_semi"), "shingles")
    members = stored(in_company(met.drop("n").join(able.select("node"), "node", "left_semi")), "members")
    removed(texts, read_all, met)
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    centre = members.join(degree, "node").groupBy("band").agg(
        F.max(F.struct("degree", "node"))["node"].alias("centre")
    )
    stars = stored(members.join(centre, "band").select("band", "node", "centre"), "stars")
    removed(members)
    pairs = stars.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    measured = stored(verified(pairs, shingles), "measured")
    classes = components(measured.filter(F.col("similarity") >= similar))
    rest = further_pairs(stars, measured, classes, able, similar)
    if not rest.isEmpty():
        links = measured.unionByName(verified(rest, shingles)).filter(F.col("similarity") >= similar)
        classes = components(links)
    removed(able, shingles, stars, measured, rest)
    classes = classes.select("node", F.col("class").alias("linked"))
    return signs.filter("node is not null").join(classes, "node", "left").select(
        "key", "node", F.coalesce("linked", "node").alias("class")
    ).unionByName(signs.filter("node is null").select("key", "node", F.lit(None).cast("binary").alias("class")))


def further_pairs(
    stars: DataFrame, measured: DataFrame, classes: DataFrame, able: DataFrame, similar: float
) -> DataFrame:
    """Pairs (a, b) of one band in different classes that may be linked, though not by their band's centre.

    A node with weight w, of which c is common, can only be linked to weights from similar * w to
    c / similar + c - w; a pair joins where the other weight's bin lies in that range. Two nodes share at most the
    lesser of their parts inside the centre and the lesser of their common parts outside it. A bin that many
    nodes of a band fall into is cut into blocks. The result is a stored table.
    """
    near = measured.select(F.col("a").alias("centre"), F.col("b").alias("node"), (1 - F.col("similarity")).alias("d"))
    placed = (
        stars.join(near, ["centre", "node"], "left").join(able, "node").join(classes, "node", "left")
        .join(able.select(F.col("node").alias("centre"), F.col("whole").alias("centre_whole")), "centre")
        .withColumn("inside", F.coalesce(
            (1 - F.col("d")) * (F.col("whole") + F.col("centre_whole")) / (2 - F.col("d")), F.col("whole")
        ))
        .select(
            "band", "node", "whole", "common", "inside", F.coalesce("d", F.lit(0.0)).alias("d"),
            F.coalesce("class", "node").alias("class"), (F.col("node") == F.col("centre")).alias("is_centre"),
        )
    )
    main = placed.filter("is_centre").select("band", F.col("class").alias("main"))
    placed = placed.join(main, "band")
    open_bands = placed.filter("class != main").select("band").distinct()
    placed = stored(placed.join(open_bands, "band", "left_semi"), "open")
    # Weight bins of 2 percent.
    bin_of = lambda w: F.floor(F.log(w) / F.log(F.lit(1.02))).cast("int")
    least = F.col("whole") * (similar - 1e-6)
    most = F.col("common") / (similar - 1e-6) + F.col("common") - F.col("whole")
    a = placed.filter("class != main").filter(most >= least).select(
        "band", F.explode(F.sequence(bin_of(least), bin_of(most))).alias("bin"),
        F.col("node").alias("a"), F.col("d").alias("da"), F.col("class").alias("ca"),
        F.col("whole").alias("wa"), F.col("common").alias("sa"), F.col("inside").alias("ia"),
    )
    b = placed.filter("not is_centre").select(
        "band", bin_of(F.col("whole")).alias("bin"), F.col("node").alias("b"), F.col("d").alias("db"),
        F.col("class").alias("cb"), F.col("whole").alias("wb"), F.col("common").alias("sb"), F.col("inside").alias("ib"),
        (F.col("class") == F.col("main")).alias("b_main"),
    )
    outside = F.greatest(F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib")), F.lit(0.0))
    shared = F.least(F.least("sa", "sb", "wa", "wb"), F.least("ia", "ib") + outside)
    may = (
        (F.col("ca") != F.col("cb"))
        & (F.col("b_main") | (F.col("a") < F.col("b")))
        & (F.abs(F.col("da") - F.col("db")) <= 1 - similar + 1e-6)
        & (shared >= (similar - 1e-6) * (F.col("wa") + F.col("wb") - shared))
    )
    met = split_join(a, b, ["band", "bin"]).filter(may)
    rest = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
    removed(placed)
    return rest


def labelled(docs: DataFrame, key="doc_id", text="text", similar: float = SIMILAR) -> DataFrame:
    """key, class_id (least key of the class) and n_class (rows in it) of every row.

    A text without words (null, empty, white space) is alone in a class of its own key. Repeated rows and rows
    that share a key are rows of their own in counts. Null keys are passed over for class_id, which is null
    only where all keys of a class are. Other columns are ignored.
    """
    found = near_classes(docs, key, text, similar)
    known = found.filter("class is not null")
    ids = known.groupBy("class").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    return (
        known.join(ids, "class").select("key", "class_id", "n_class")
        .unionByName(
            found.filter("class is null").select("key", F.col("key").alias("class_id"), F.lit(1).cast("bigint").alias("n_class"))
        )
        .withColumnRenamed("key", key)
    )


def maybe_among(rows: DataFrame, value, others: DataFrame, other) -> tuple[DataFrame, DataFrame]:
    """(rows whose value surely is not among the others, all other rows): a bitmap decides, rows are not shuffled.

    Values are 64-bit hashes. The bitmap has FILTER_BITS bits, however many others there are, in pieces of 4 KB.
    """
    bit = lambda v: F.pmod(v, F.lit(FILTER_BITS)) + 1  # noqa: E731  (bitmap functions number bits from 1)
    pieces = others.select(bit(other).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bitmap_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap_bits")
    )
    place = F.bitmap_bit_position(bit(value))
    byte = F.conv(F.hex(F.substring("bitmap_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(pieces), F.bitmap_bucket_number(bit(value)) == F.col("bitmap_piece"), "left")
    maybe = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return tuple(met.filter(c).drop("bitmap_piece", "bitmap_bits") for c in (~maybe, maybe))


def one_of_each(docs: DataFrame, key="doc_id", text="text", similar: float = SIMILAR) -> DataFrame:
    """The documents with the least key of each class, and all without words; columns as they were.

    Of rows with equal key and text the least in all columns stays. Rows whose key is null stay only if their class has no other key.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct(F.col(key).alias("key"), digest.alias("digest")).alias("id"), F.col(text).alias("body"))
    found = stored(near_classes(rows, "id", "body", similar).filter("class is not null"), "classes")
    order = F.struct(F.col("key.key").isNull(), F.col("key.key"), F.col("key.digest"))
    ids = found.groupBy("class").agg(F.min_by("key", order).alias("first"))
    gone = stored(
        found.join(ids, "class").filter(~F.col("key").eqNullSafe(F.col("first"))).select("key.*").distinct()
        .select(F.col("key").alias("gone_key"), F.col("digest").alias("gone_digest")), "gone",
    )
    mine = lambda df: F.xxhash64(F.coalesce(df[text], F.lit("")))
    # Texts that surely stay are not shuffled; the others are joined.
    sure, asked = maybe_among(docs, mine(docs), gone, F.col("gone_digest"))
    kept = sure.unionByName(
        asked.join(gone, asked[key].eqNullSafe(gone["gone_key"]) & (mine(asked) == gone["gone_digest"]), "left_anti")
    )
    twice = stored(
        found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key.*")
        .select(F.col("key").alias("twice_key"), F.col("digest").alias("twice_digest")), "twice",
    )
    if twice.isEmpty():
        return kept
    same = kept[key].eqNullSafe(twice["twice_key"]) & (mine(kept) == twice["twice_digest"])
    least = F.min(F.struct(*[kept[c] for c in kept.columns])).alias("row")
    return kept.join(twice, same, "left_anti").unionByName(
        kept.join(twice, same, "left_semi").groupBy(kept[key], kept[text]).agg(least).select("row.*")
    )


def run(spark, sf_dir):
    return labelled(read(spark, sf_dir, "documents"))
