"""Hard negatives by BOND: a vertical scan of columns with shrinking candidate bitmaps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from placeweave.llm.native import fresh, read
from placeweave.llm.store import stored
from placeweave.llm.vectors import HELD_ROWS, common_size, matrix, meet, usable

POSITIVES, NEGATIVES = 5, 3
#: A negative scores from so many to so many hundredths of the positive's score.
LOW_SHARE, HIGH_SHARE = 50, 95
#: Components become floor(SCALE * x).
SCALE = 256
#: Rows in a columnar block, dimensions read between two looks at the bounds, anchors that travel together.
BLOCK_ROWS, STEP, ANCHORS = 8192, 16, 128
#: Anchors that one task meets, at most about.
ANCHORS_PER_TASK = 2**18
LARGEST = 10**37


def exact_kind(most: int):
    """The fastest number type in which sums up to ``most`` are exact."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as doubles; products beyond a double are its largest value."""
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(SCALE * values, -most, most))


def as_text(score) -> str:
    """Scores travel as text, because whole sums may pass a long; LARGEST bounds what SQL compares."""
    return str(max(-LARGEST, min(LARGEST, int(score))))


def as_exact(values: np.ndarray, kind):
    if kind is object:
        return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)
    return values.astype(kind)


class Block:
    """Up to BLOCK_ROWS rows, stored by column, with the least and the largest value of every column."""

    def __init__(self, ids, labels, values):
        self.ids, self.labels = ids, labels
        self.values = np.ascontiguousarray(values.T)
        self.low, self.high = self.values.min(axis=1), self.values.max(axis=1)
        self.most = float(np.abs(self.values).max())
        self.kinds = {}

    def columns(self, anchor_most):
        """(columns, low, high) in a type in which every sum with this anchor is exact."""
        kind = exact_kind(self.most * anchor_most * len(self.values))
        if kind not in self.kinds:
            self.kinds[kind] = tuple(as_exact(x, kind) for x in (self.values, self.low, self.high))
        return kind, *self.kinds[kind]


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, useful):
    """(positions, exact scores) of the rows of ``alive`` that stay useful to the last dimension.

    Columns are read in descending magnitude of the anchor's components. After each step the least and the
    largest contribution of all unread columns bound every score, and ``useful(low, high)`` shrinks the bitmap.
    """
    kind, columns, low, high = block.columns(float(np.abs(anchor).max()))
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = as_exact(anchor[order], kind)
    ends = np.stack([weights * low[order], weights * high[order]])
    none = np.zeros(1, ends.dtype)
    rest_low, rest_high = (np.concatenate([np.cumsum(x[::-1])[::-1], none]) for x in (ends.min(axis=0), ends.max(axis=0)))
    bitmap = alive.copy()
    at = np.flatnonzero(bitmap)
    sums = np.zeros(len(at), kind)
    for start in range(0, len(order), STEP):
        stop = min(start + STEP, len(order))
        read_now = order[start:stop]
        if 2 * len(at) > len(bitmap):
            sums = sums + (weights[start:stop] @ columns[read_now])[at]
        else:
            sums = sums + weights[start:stop] @ columns[np.ix_(read_now, at)]
        if stop < len(order) and len(at):
            keep = useful(sums + rest_low[stop], sums + rest_high[stop])
            bitmap[at[~keep]] = False
            at, sums = at[keep], sums[keep]
    return at, sums


def kth(values, k):
    """The k-th largest, None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def nearest(blocks, anchor, anchor_id, label, most):
    """(ids, scores) of the best ``most`` rows of the anchor's label, its own id left out."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, object)
    for block in blocks:
        floor = scores[-1] if len(scores) == most else None

        def useful(low, high, floor=floor):
            least = kth(low, most)
            keep = np.ones(len(low), bool) if least is None else high >= least
            return keep if floor is None else keep & (high >= floor)

        at, found = scan(block, anchor, (block.labels == label) & (block.ids != anchor_id), useful)
        ids = np.concatenate([ids, block.ids[at]])
        scores = np.concatenate([scores, [int(x) for x in found]]).astype(object)
        best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:most]
        ids, scores = ids[best], scores[best]
    return ids, scores


def in_windows(blocks, anchor, anchor_id, label, windows, most):
    """For each window (low, high): the best ``most`` (score, id) of other labels inside it."""
    best = {w: [] for w in windows if w[0] <= w[1]}
    for block in blocks if best else []:
        def useful(low, high):
            keep = np.zeros(len(low), bool)
            for (least, largest), found in best.items():
                inside = (high >= least) & (low <= largest)
                sure = kth(low[(low >= least) & (high <= largest)], most)
                if sure is not None:
                    inside &= high >= sure
                if len(found) == most:
                    inside &= high >= found[-1][0]
                keep |= inside
            return keep

        at, scores = scan(block, anchor, (block.labels != label) & (block.ids != anchor_id), useful)
        for (least, largest), found in best.items():
            fits = np.flatnonzero((scores >= least) & (scores <= largest))
            if len(fits) > most:
                fits = fits[scores[fits] >= kth(scores[fits], most)]
            found += [(int(scores[i]), int(block.ids[at[i]])) for i in fits]
            found.sort(key=lambda x: (-x[0], x[1]))
            del found[most:]
    return best


def packed(anchors: DataFrame, size: int, extra: list[str], groups: int, sides: int) -> DataFrame:
    """Anchors in blocks of ANCHORS as one row each, copied to every group of rows."""
    fields = ["id", "label", "vector", *extra]
    spread = F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int")
    dealt = anchors.select(*fields, spread.alias("side"))
    kinds = dict(dealt.dtypes)
    schema = "side int, " + ", ".join(f"many_{c} array<{kinds[c]}>" for c in fields)

    def run(batches):
        for batch in batches:
            marks = batch.column("side").to_numpy()
            for side in np.unique(marks):
                own = batch.filter(pa.array(marks == side))
                for start in range(0, own.num_rows, ANCHORS):
                    some = own.slice(start, ANCHORS)
                    lists = [pa.array([some.column(c).to_pylist()], pa.list_(some.column(c).type)) for c in fields]
                    yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), *lists], names=["side", *(f"many_{c}" for c in fields)])

    return dealt.mapInArrow(run, schema).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def hard_negatives(
    df: DataFrame, is_anchor, key="vec_id", vector="embedding", label="label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_SHARE, high: int = HIGH_SHARE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition on the column ``id``. An anchor's positives are its best other rows of the same
    label; for each, the best rows of other labels follow whose score lies from ``low`` to ``high`` hundredths of the
    positive's. Scores are integer inner products of floor(256 * component); ties go to the smaller id.

    The rows are cut into groups of about HELD_ROWS and meet the anchors in blocks, twice: once for the positives,
    once for the windows which these open. Nothing is bounded but what the bounds of unread columns rule out.

    Rows with a null id or label, or a vector that is null, empty or not finite take no part; nor do vectors whose
    length is not the most frequent one. Rows of one id count once (the least). Vectors of zeros take part.
    An anchor without positives, or a positive without negatives, has no rows. Sums beyond 2^53 are taken in whole
    numbers; scores beyond LARGEST count as LARGEST, and those beyond a long are clipped in the output. Other columns are ignored; an empty table gives no rows.
    """
    fresh(df, key, vector, label)
    rows = usable(df.select(key, vector, F.col(label).cast("bigint").alias("label")), key, vector, "label")
    rows = stored(rows.withColumn("id", F.col("id").cast("bigint")), "vectors")
    size, n = common_size(rows)
    rows = rows.filter(F.size("vector") == size)
    anchors = rows.filter(is_anchor)
    sides = max(1, -(-anchors.count() // ANCHORS_PER_TASK))
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n // HELD_ROWS), min(-(-n // BLOCK_ROWS), 2 * cores))
    tasks = 2 * groups * sides
    grouped = rows.select(
        "id", "label", "vector", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("grp"),
        F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"),
    )

    def hold(table):
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        values = whole(matrix(table.column("vector"), size))
        return [Block(ids[i : i + BLOCK_ROWS], labels[i : i + BLOCK_ROWS], values[i : i + BLOCK_ROWS]) for i in range(0, len(ids), BLOCK_ROWS)]

    def each(probe):
        vectors = whole(np.array(probe["many_vector"], np.float64))
        return zip(probe["many_id"], probe["many_label"], vectors)

    def find_positives(blocks, probe):
        out = []
        for anchor_id, own, anchor in each(probe):
            out += [(anchor_id, int(i), as_text(s)) for i, s in zip(*nearest(blocks, anchor, anchor_id, own, positives))]
        columns = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["anchor_id", "id", "score"])

    def find_negatives(blocks, probe):
        out = []
        for (anchor_id, own, anchor), found in zip(each(probe), probe["many_found"]):
            window = {x["score"]: (-((-low * int(x["score"])) // 100), (high * int(x["score"])) // 100) for x in found}
            best = in_windows(blocks, anchor, anchor_id, own, set(window.values()), negatives)
            for x in found:
                out += [(anchor_id, x["id"], x["score"], i, as_text(s)) for s, i in best.get(window[x["score"]], [])]
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor_id", "id", "score", "negative_id", "negative_score"])

    def first(found, keys, score, other, most):
        by = Window.partitionBy(*keys).orderBy(F.desc(F.col(score).cast("decimal(38,0)")), other)
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)

    probes = packed(anchors, size, [], groups, sides)
    found = meet(grouped, probes, ["grp", "side"], ["id"], tasks, hold, find_positives, "anchor_id bigint, id bigint, score string")
    found = first(found, ["anchor_id"], "score", "id", positives).groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct("id", "score")).alias("found")  # at most ``positives``
    )
    known = stored(anchors.join(found, "id"), "positives")
    probes = packed(known, size, ["found"], groups, sides)
    found = meet(
        grouped, probes, ["grp", "side"], ["id"], tasks, hold, find_negatives,
        "anchor_id bigint, id bigint, score string, negative_id bigint, negative_score string",
    )
    found = first(found, ["anchor_id", "id"], "negative_score", "negative_id", negatives)

    def long(name):
        value = F.col(name).cast("decimal(38,0)")
        ends = [F.lit(str(x)).cast("decimal(38,0)") for x in (-(2**63), 2**63 - 1)]
        return F.greatest(ends[0], F.least(ends[1], value)).cast("bigint")

    return found.select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        long("score").alias("positive_score"), long("negative_score").alias("negative_score"),
    )


def run(spark, sf_dir):
    """Anchors are the rows whose id 50 divides; where 7 divides it, the label moves on by one."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 50 == 0)
