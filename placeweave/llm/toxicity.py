"""Toxicity of texts: disguised words are restored by a noisy channel, then restored words are scored."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placeweave.llm.buffers import slices
from placeweave.llm.native import fresh, let, read

#: Letter classes of the language model: 0 edge of a word, 1-26 a-z without accents, 27 other letters.
LETTERS = 28
#: Labelled rows that the scorer is fitted on, those of smallest hash; half of it weighs, half calibrates.
FIT_ROWS = 12_000
#: A feature counts if its log odds are so many standard errors above zero.
LEAST_Z = 3.5
MOST_CACHED = 200_000

# Signs that stand for letters.
STAND_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c",
}
SEPARATORS = "-_.*~'`,/\\^:;​‌‍­"
KEPT, SWAPPED, REPEATED, PARTED = math.log(0.97), math.log(0.3), math.log(0.4), math.log(0.6)
#: A sign that ends a word costs nothing, as the best reading without any end is kept as well.
BROKEN = 0.0

WORD = re.compile(r"[^\W\d_]+")
PUNCTUATION = ".,;:!?\"'()[]{}<>&%#*$-_|"
#: A chunk from behind, without the punctuation and paired signs at its end.
LAST = re.compile(r"[^\w@$]*(?:[$@]{2,})?(.*)", re.S)
TRIPLED = re.compile(r"(.)\1{2,}")
THRICE = re.compile(r"([^\W\d_])\1\1")
#: Letters spaced out one by one.
SPACED = re.compile(
    rf"(?<!\S)[^\W_](?:[ {re.escape(SEPARATORS)}]{{1,2}}[^\W_@$!]){{2,}}(?![^\s{re.escape(SEPARATORS)}!?])"
)
#: Hexadecimal digests and UUIDs are no disguised words; their plain words still count.
DIGEST = re.compile(
    r"(?=.*\d)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})"
)
#: Longer chunks are read anew each time, so that the cache stays small.
LONGEST_CACHED = 200


def letter_classes():
    """Class of every code point of the basic plane: accents fold to their letter."""
    table = np.zeros(65536, np.uint8)
    for c in range(65536):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or not ch.isalpha():
            continue
        base = unicodedata.normalize("NFD", ch)[0].lower()
        table[c] = ord(base[0]) - 96 if "a" <= base[0] <= "z" and len(base) == 1 else 27
    return table


def trigram_counts(batches):
    """(gram, n): letter trigrams of one part of the corpus, words edged by class 0."""
    table = letter_classes()
    counts = np.zeros(LETTERS**3, np.int64)
    for batch in slices(batches, "text"):
        text = "  ".join(t for t in batch.column("text").to_pylist() if t)
        codes = np.frombuffer(f"  {text}  ".encode("utf-32-le", "replace"), "<u4")
        c = table[np.minimum(codes, 65535)].astype(np.int64)
        # Only trigrams with a letter in the middle or at the end of a word.
        gram = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
        counts += np.bincount(gram[(c[1:-1] > 0)], minlength=LETTERS**3)
        starts = (c[:-1] == 0) & (c[1:] > 0)
        counts[:LETTERS] += np.bincount(c[1:][starts], minlength=LETTERS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["gram", "n"])


def language_model(docs: DataFrame, text="text") -> np.ndarray:
    """log P(letter | two before) from the trigrams of all documents, smoothed by bigrams and letters."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(trigram_counts, "gram int, n bigint")
    table = rows.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most LETTERS ** 3 rows
    counts = np.zeros(LETTERS**3)
    counts[table.column("gram").to_numpy()] = table.column("n").to_numpy()
    three = counts.reshape(LETTERS, LETTERS, LETTERS)
    two, one = three.sum(0), three.sum((0, 1))
    share = lambda x: (x + 0.5) / (x + 0.5).sum(-1, keepdims=True)
    backed = 0.8 * share(two) + 0.2 * share(one)
    weight = three.sum(-1, keepdims=True)
    weight = weight / (weight + 50.0)
    return np.log(weight * share(three) + (1 - weight) * backed[None]).astype(np.float32)


class Restorer:
    """Best reading of a disguised chunk: Viterbi over a lattice of letters under the language model."""

    def __init__(self, model):
        self.model = model.tolist()
        self.known = {}
        self.signs = {}

    @staticmethod
    def letter(ch):
        base = unicodedata.normalize("NFD", ch)[0]
        return ord(base) - 96 if "a" <= base <= "z" else 27

    def readings(self, chunk):
        """Words of a chunk without white space: the plain ones, and restored ones if it looks disguised."""
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) > MOST_CACHED:
                self.known.clear()
            plain = WORD.findall(chunk)
            bare = chunk.strip(PUNCTUATION)
            fronted = chunk[:1] in STAND_FOR and chunk[1:2].isalpha()
            odd = plain and (fronted or not bare.isalpha() or THRICE.search(bare))
            found = (*plain, *(self.decoded(chunk) if odd else ()))
            if len(chunk) <= LONGEST_CACHED:
                self.known[chunk] = found
        return found

    def options(self, ch):
        """(class, letter, cost) of each letter that a sign can be, and whether it can stand between letters."""
        found = self.signs.get(ch)
        if found is None:
            letters = [(self.letter(o), o, SWAPPED) for o in STAND_FOR.get(ch, "")]
            if ch.isalpha():
                letters.append((self.letter(ch), ch, KEPT))
            found = self.signs[ch] = (letters, ch in SEPARATORS or ch == " " or not letters)
        return found

    def decoded(self, chunk):
        """Words of the best reading as one word and of the best one in several words, for any length."""
        # Signs behind a word are punctuation, save for digits and letter-like signs.
        chunk = re.sub(r"^[^\w@$!|+]+", "", chunk)
        chunk = LAST.match(chunk[::-1]).group(1)[::-1]
        if DIGEST.fullmatch(chunk) or not WORD.search(chunk):
            return ()
        model = self.model
        # state: (letter before last, last letter, whether a word has ended) -> (score, path); a path is
        # (path before, letter), so that readings share what they have in common.
        states = {(0, 0, False): (0.0, None)}
        previous = ""
        for ch in chunk:
            after = {}
            letters, between = self.options(ch)
            again = ch == previous and ch.isalpha()
            for state, (score, path) in states.items():
                a, b, broken = state
                row = model[a][b]
                for c, o, cost in letters:
                    to, s = (b, c, broken), score + cost + row[c]
                    if to not in after or after[to][0] < s:
                        after[to] = (s, (path, o))
                if between:
                    s = score + PARTED
                    if state not in after or after[state][0] < s:
                        after[state] = (s, path)
                    if b:
                        to, s = (0, 0, True), score + BROKEN + row[0]
                        if to not in after or after[to][0] < s:
                            after[to] = (s, (path, " "))
                if again and path:
                    s = score + REPEATED
                    if state not in after or after[state][0] < s:
                        after[state] = (s, path)
            states, previous = after, ch
        out = set()
        for kind in (False, True):
            ends = [(s + (model[a][b][0] if b else 0.0), path) for (a, b, broken), (s, path) in states.items() if broken == kind]
            if not ends:
                continue
            path, letters = max(ends, key=lambda e: e[0])[1], []
            while path:
                path, letter = path
                letters.append(letter)
            for word in "".join(reversed(letters)).split():
                out.update(w for w in (word, TRIPLED.sub(r"\1", word)) if len(w) > 1)
        return tuple(out)

    def words(self, text):
        """Distinct words of a text, plain and restored."""
        text = unicodedata.normalize("NFC", text).lower()
        out = set()
        for chunk in set(text.split()):
            out.update(self.readings(chunk))
        for m in SPACED.finditer(text):
            out.update(self.decoded(m.group()))
        return out


def features(words):
    """Whole words and the beginnings of words, which catch inflected forms."""
    out = {"w:" + w for w in words}
    for n in (4, 5, 6):
        out.update("b:" + w[:n] for w in words if len(w) >= n)
    return out


def feature_counts(model):
    """Function over batches (text, toxic): (feature, toxic documents, other documents) of one part."""

    def run(batches):
        restorer = Restorer(model.value)
        counts = {0: Counter(), 1: Counter()}
        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update(features(restorer.words(text or "")))
            if sum(map(len, counts.values())) > MOST_CACHED * 5:
                yield counted(counts)
                counts = {0: Counter(), 1: Counter()}
        yield counted(counts)

    return run


def counted(counts):
    names = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_pydict(
        {"feature": names, "bad": [counts[1][n] for n in names], "good": [counts[0][n] for n in names]},
        schema=pa.schema([("feature", pa.string()), ("bad", pa.int64()), ("good", pa.int64())]),
    )


class Scorer:
    """Evidence of a text: the largest log odds among its words, and the sum of the next two."""

    def __init__(self, model, weights):
        self.restorer = Restorer(model)
        self.whole = {k[2:]: v for k, v in weights.items() if k[0] == "w"}
        self.begun = {k[2:]: v for k, v in weights.items() if k[0] == "b"}

    def evidence(self, text):
        best = {}
        for w in self.restorer.words(text):
            v = self.whole.get(w, 0.0)
            for n in (4, 5, 6):
                v = max(v, self.begun.get(w[:n], 0.0)) if len(w) >= n else v
            if v:
                best[w] = v
        top = sorted(best.values(), reverse=True)[:3]
        return sum(top[:1]), sum(top[1:])


def evidence_rows(model, weights, line):
    """Function over batches (key, text): key and score; without a line, both parts of the evidence."""

    def run(batches):
        scorer = Scorer(model.value, weights.value)
        for batch in slices(batches, "text"):
            x = np.array([scorer.evidence(t or "") for t in batch.column("text").to_pylist()])
            if line:
                parts = {"score": 1 / (1 + np.exp(-(line[0] + x @ np.array(line[1:]))))}
            else:
                parts = {"first": x[:, 0], "others": x[:, 1]}
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(v, pa.float64()) for v in parts.values()]], names=["key", *parts]
            )

    return run


def logistic(x, y):
    """Intercept and slopes of a logistic regression, by Newton steps with a small ridge on the slopes."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6] + [0.05] * (a.shape[1] - 1))
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def held_out(key):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


class Toxicity:
    """A fitted scorer: letter model of all documents, feature weights and a logistic line from labelled rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic", fit_rows=FIT_ROWS):
        fresh(docs, key, text)
        fresh(labels, key, label)
        spark = docs.sparkSession
        send = spark.sparkContext.broadcast
        self.model = send(language_model(docs, text))
        # Bounded by fit_rows: the labelled rows of smallest hash outside the held-out fifth.
        draw = F.xxhash64(F.col(key).cast("string"), F.lit("fit"))
        chosen = (
            labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
            .groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
            .withColumn("draw", F.xxhash64(F.col("id").cast("string"), F.lit("fit")))
            .orderBy("draw", "id").limit(fit_rows)
        )
        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
        # Copies would make all their words look telling; one row of each sketch of five-word runs stays.
        words = F.split(F.lower(F.coalesce("text", F.lit(""))), "\\s+")
        runs = let(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, 5))
            ),
        )
        sketch = rows.select("id", "toxic", "draw", F.array_min(runs).alias("sketch"))
        one = sketch.groupBy("sketch").agg(F.min(F.struct("draw", "id"))["id"].alias("id")).select("id")
        rows = rows.join(F.broadcast(one), "id", "left_semi")  # at most fit_rows ids
        half = F.pmod("draw", F.lit(3)) > 0
        counted_rows = rows.filter(half)
        seen = counted_rows.groupBy("toxic").count().collect()
        n = {r["toxic"]: r["count"] for r in seen}
        bad, good = n.get(1, 0) + 1.0, n.get(0, 0) + 1.0
        log_odds = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good)
        error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        telling = (
            counted_rows.select("text", "toxic").mapInArrow(feature_counts(self.model), "feature string, bad bigint, good bigint")
            .groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
            .filter("bad >= 3").withColumn("weight", log_odds).filter(F.col("weight") / error >= LEAST_Z)
        )
        # A bounded sample has boundedly many features.
        self.weights = send({r["feature"]: r["weight"] for r in telling.select("feature", "weight").collect()})
        pairs = (
            rows.filter(~half).select(F.col("toxic").alias("key"), "text")
            .mapInArrow(evidence_rows(self.model, self.weights, None), "key int, first double, others double").collect()
        )
        self.line = [-3.0, 1.0, 0.0]
        if pairs:
            self.line = logistic(np.array([p[1:] for p in pairs]), np.array([p[0] for p in pairs], float))

    def score(self, docs: DataFrame, key="doc_id", text="text") -> DataFrame:
        """key, held_out, score and predicted of every row.

        Null and empty texts have no evidence and get the score of such. Repeated rows give repeated rows;
        a null key counts as the empty text in held_out. Other columns are ignored. Without labels the score
        is the same for all.
        """
        fresh(docs, key, text)
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        kind = rows.schema["key"].dataType.simpleString()
        scored = rows.mapInArrow(evidence_rows(self.model, self.weights, self.line), f"key {kind}, score double")
        return scored.withColumnRenamed("key", key).select(
            key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
        )

    def keep_clean(self, docs: DataFrame, text="text", least: float = 0.5) -> DataFrame:
        """The rows that score below ``least``, all columns as they were; texts never leave their partition."""
        scorer = (self.model, self.weights, self.line)

        def run(batches):
            for batch in slices(batches, text):
                found = evidence_rows(*scorer)([pa.RecordBatch.from_arrays([batch.column(text)] * 2, names=["key", "text"])])
                scores = np.concatenate([b.column("score").to_numpy() for b in found] or [np.zeros(0)])
                yield batch.filter(pa.array(scores < least))

        return docs.mapInArrow(run, docs.schema)


def run(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return Toxicity(docs, labels).score(docs)
