"""Byte-level BPE by speculation: greedy longest tokens, checked pair by pair, merged only where a check fails."""

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from placeweave.llm.buffers import slices
from placeweave.llm.native import fresh, read

# Fixed value: how byte-level BPE cuts a text into words. White space is spelt out, because libraries differ
# in whether \s holds U+001C to U+001F.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUTS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^"
    + SPACE + r"])|[" + SPACE + r"]+"
)
#: A cache is emptied beyond so many entries, so memory stays bounded.
MOST_WORDS = 300_000
MOST_PAIRS = 1_000_000


def byte_letters():
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Coder:
    """Encodes words with one vocabulary file; results of words and pairs are remembered, within bounds."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        spell = lambda token: bytes(byte_of[c] for c in token)
        vocabulary = content["model"]["vocab"]
        self.ids = {spell(token): i for token, i in vocabulary.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = [b""] * (max([*self.ids.values(), *(t["id"] for t in content["added_tokens"])]) + 1)
        for token, i in self.ids.items():
            self.bytes[i] = token
        # (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, (a, b) in enumerate(content["model"]["merges"]):
            a, b = spell(a), spell(b)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        names = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cut = regex.compile(CUTS)
        self.words = {}
        self.pairs = {}
        self.exact_words = 0

    def proposal(self, word):
        """Longest token first, from the left."""
        ids, at, n = [], 0, len(word)
        while at < n:
            stop = min(n, at + self.longest)
            while word[at:stop] not in self.ids:
                stop -= 1
            ids.append(self.ids[word[at:stop]])
            at = stop
        return ids

    def merged(self, word):
        """Merge by merge in order of rank, leftmost first: the definition, with a heap for long words."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = following[i]
            if j < n:
                found = self.merges.get((ids[i], ids[j]))
                if found:
                    heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            if ids[i] != left or following[i] >= n or ids[following[i]] != right:
                continue
            j = following[i]
            ids[i], ids[j] = new, -1
            following[i] = following[j]
            if following[i] < n:
                before[following[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def fits(self, a, b):
        """Whether two neighbouring tokens (or one, if b is -1) are what merging their bytes gives."""
        if b < 0:
            return self.merged(self.bytes[a]) == [a]
        return self.merged(self.bytes[a] + self.bytes[b]) == [a, b]

    def learn(self, words):
        """Add words to the cache: propose for all, test all pairs at once, merge the words that fail."""
        spelt = [w.encode() for w in words]
        proposed = [self.proposal(w) for w in spelt]
        sizes = np.array([len(p) for p in proposed])
        ids = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        last = np.ones(len(ids), bool)
        last[:-1] = owner[1:] != owner[:-1]
        right = np.append(ids[1:], -1)
        # Words of one token are tested as such; others by their pairs.
        single = sizes[owner] == 1
        right[last] = -1
        tested = single | ~last
        keys = (ids << 32) | (right + 1)
        distinct, place = np.unique(keys[tested], return_inverse=True)
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs
        for key in distinct.tolist():
            if key not in known:
                known[key] = self.fits(key >> 32, (key & 0xFFFFFFFF) - 1)
        good = np.fromiter((known[k] for k in distinct.tolist()), bool, len(distinct))[place]
        failed = np.zeros(len(words), bool)
        failed[owner[tested][~good]] = True
        for i in np.flatnonzero(failed).tolist():
            proposed[i] = self.merged(spelt[i])
        self.exact_words += int(failed.sum())
        for w, p in zip(words, proposed):
            self.words[w] = np.array(p, "<u4").tobytes()

    def cuts(self, text):
        """The words of a text; added tokens are words of their own."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self.cut.findall(text)
        out = []
        for i, part in enumerate(self.split_added.split(text)):
            out += [part] if i % 2 else self.cut.findall(part)
        return out

    def encode(self, texts):
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        if not self.words:
            self.words.update({t: np.array([i], "<u4").tobytes() for t, i in self.added.items()})
        cut = [self.cuts(t) for t in texts]
        new = list({w for words in cut for w in words if w not in self.words})
        if new:
            self.learn(new)
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def decode(self, ids):
        """UTF-8 of the text that the ids stand for; broken sequences become U+FFFD."""
        whole = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return whole.decode("utf-8", "replace").encode()


def coded(path, with_ids):
    def run(batches):
        coder = Coder(path)
        for batch in slices(batches, "text", 1_000_000):
            ids = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            columns = [
                batch.column("key"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids], pa.string()),
            ]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(i, "<u4").astype("<i4") for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, path: str, key="doc_id", text="text", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and ids) of every document with the vocabulary at ``path``.

    ``path`` names a byte-level BPE file that every executor can open. Null texts are empty and have no
    tokens. Every row gives one row, repeated ones too. Other columns are ignored.
    """
    fresh(docs, key, text)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    out = rows.mapInArrow(coded(path, with_ids), schema + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key="doc_id", ids="ids", text="text") -> DataFrame:
    """key and text of every row of ids; null ids give a null text."""
    fresh(encoded, key, ids)
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches):
        coder = Coder(path)
        for batch in batches:
            texts = [
                None if i is None else coder.decode(np.array(i, "<u4").tobytes()).decode()
                for i in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key).withColumnRenamed("text", text)


def run(spark, sf_dir):
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
