"""Token ids in length-delimited binary records with masked checksums, and an offset index per file.

A data file is a row of records: length (8 bytes), masked checksum of the length (4), payload, masked
checksum of the payload (4); all little-endian. A payload is the document id (8), a flag (2: 1 if the id is
null), the bytes per token id (2) and the token ids as unsigned integers of two bytes if all of the
record's ids allow it, else four. The checksum is CRC-32, turned right by 15 bits and
raised by a constant, so that checksums of data that hold checksums stay apart. The index file has one
entry of 24 bytes per record in the same order: document id, place of the record in the data file, and
number of ids before it in the file.
"""

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from placeweave.llm.buffers import slices
from placeweave.llm.native import fresh, read
from placeweave.llm.store import new_folder

MASK = 0xA282EAD8
END = 1
MOST_WORDS = 600_000
HEAD, TAIL, FRONT, ENTRY = "<QI", "<I", "<qHH", "<qQQ"


def masked(data):
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def framed(payload):
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(TAIL, masked(length)) + payload + struct.pack(TAIL, masked(payload))


def unframed(data, at):
    """(payload, place of the next record); raises if a checksum differs."""
    length, check = struct.unpack_from(HEAD, data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + length]
    if len(payload) != length or masked(payload) != struct.unpack_from(TAIL, data, at + 12 + length)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + length


def packed(key, ids):
    width = 2 if int(ids.max(initial=0)) < 65536 else 4
    return struct.pack(FRONT, key or 0, key is None, width) + ids.astype(f"<u{width}").tobytes()


def unpacked(payload):
    """(document id, ids as unsigned 32-bit integers) of a payload."""
    key, none, width = struct.unpack_from(FRONT, payload)
    return None if none else key, np.frombuffer(payload[struct.calcsize(FRONT) :], f"<u{width}").astype("<u4")


#: Latin letters that stay one letter in lower case, then ASCII signs; the apostrophe may open a suffix.
SHAPE = (
    "^(?P<front>[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+)"
    r"(?P<sign>[!-&(-/:-@\[-`{-~]*)$"
)


def ragged(first, which):
    """(places, edges): the items of the chosen pieces one after the other, and where each choice begins and ends."""
    edges = np.concatenate([[0], np.cumsum(np.diff(first)[which])])
    return np.repeat(first[which] - edges[:-1], np.diff(edges)) + np.arange(edges[-1]), edges


class Library:
    """The tokenizers library; a word between ASCII white space is encoded once, as long as it is remembered.

    Valid for vocabularies that lower the case, drop white space and mark word ends, as the library then
    encodes every word by itself. Words of a-z go straight to the library's model, as its other steps leave
    them as they are. Words of other Latin letters meet it in long texts, cut apart again at the
    marks of word ends; a word with signs behind its letters is that word and the signs. All other words, and
    texts with an added token, meet it alone.
    """

    END = "</w>"

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True
        self.forget()

    def forget(self):
        """Remembered words by number: word i has the ids flat[first[i]:first[i + 1]]; word 0 is empty."""
        self.known = {"": 0}
        self.flat, self.first = np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def ids(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def remember(self, words, ids, sizes):
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words))))
        self.flat = np.concatenate([self.flat, np.array(ids, "<u4")])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes, dtype=np.int64)])

    def letters(self, words):
        """Remember words of letters only."""
        tokens, plain = self.model.tokenize, [w for w in words if w.isascii()]
        other = [w for w in words if not w.isascii()]
        ids = [t.id for w in plain for t in tokens(w)]
        for i in range(0, len(other), 10_000):
            ids += self.ids(" ".join(other[i : i + 10_000]))
        cuts = np.flatnonzero(self.ends[np.array(ids, np.int64)]) + 1
        if len(cuts) != len(words):
            raise ValueError("the vocabulary does not mark the end of every word")
        self.remember(plain + other, ids, np.diff(cuts, prepend=0))

    def numbers(self, fronts, signs, others):
        """Numbers of three lists of distinct words: of letters only, of signs only, and others (which may be signs)."""
        if len(self.known) + len(fronts) > MOST_WORDS:
            self.forget()
        self.letters([w for w in fronts if w not in self.known])
        new = [w for w in dict.fromkeys(signs + others) if w not in self.known]
        each = [self.ids(w) for w in new]
        self.remember(new, [i for ids in each for i in ids], [len(ids) for ids in each])
        return (np.fromiter(map(self.known.__getitem__, some), np.int64, len(some)) for some in (fronts, signs, others))

    def distinct(self, words):
        """(ids, edges) of distinct words."""
        shape = pc.extract_regex(words, SHAPE)
        plain = shape.is_valid().to_numpy(zero_copy_only=False)
        fronts, signs = (pc.drop_null(shape).field(c).dictionary_encode() for c in ("front", "sign"))
        others = words.filter(pa.array(~plain)).to_pylist()
        both = np.zeros((len(words), 2), np.int64)
        front, sign, other = self.numbers(fronts.dictionary.to_pylist(), signs.dictionary.to_pylist(), others)
        both[plain, 0], both[plain, 1] = front[fronts.indices.to_numpy()], sign[signs.indices.to_numpy()]
        both[~plain, 0] = other
        places, edges = ragged(self.first, both.ravel())
        return self.flat[places], edges[::2]

    def encode(self, column):
        """Ids of each text of a string column; those of a null are empty."""
        column = pc.fill_null(column, "")
        alone = np.zeros(len(column), bool)
        for token in self.added:
            alone |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        # Case is lowered for ASCII here; the vocabulary would do it anyway.
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(alone), "", column)))
        each = words.flatten().dictionary_encode()
        flat, first = self.distinct(each.dictionary)
        places, edges = ragged(first, each.indices.to_numpy())
        ids, edges = flat[places], edges[words.offsets.to_numpy()]
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
        for i in np.flatnonzero(alone).tolist():
            out[i] = np.array(self.ids(column[i].as_py()), "<u4")
        return out


@lru_cache(maxsize=1)
def library(path):
    """One for each Python worker, so that a later task of the same worker finds the words of earlier ones."""
    return Library(path)


def written(path, folder):
    """Function over sorted batches: writes one data file and one index file, and says where they are.

    Every attempt writes files of its own name; only those whose name reaches the list of files count, so
    a task that runs again after a lost executor harms nothing.
    """

    def run(batches):
        coder = library(path)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        base = f"{base}/{name.rsplit('/', 1)[1]}"
        docs = ids = at = 0
        with files.open_output_stream(base + ".rec") as data, files.open_output_stream(base + ".idx") as index:
            for batch in slices(batches, "text", 4_000_000):
                for key, own in zip(batch.column("key").to_pylist(), coder.encode(batch.column("text"))):
                    own = np.append(own, np.uint32(END))
                    record = framed(packed(key, own))
                    index.write(struct.pack(ENTRY, key or 0, at, ids))
                    data.write(record)
                    docs, ids, at = docs + 1, ids + len(own), at + len(record)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [docs], "ids": [ids], "size": [at]})

    return run


def write_records(docs: DataFrame, path: str, folder: str, key="doc_id", text="text", files: int | None = None) -> DataFrame:
    """Write every document, in ascending order of the key over all files, nulls first; returns the files.

    Columns: part (order of the files), file (name without ending), docs, ids, size, before (ids in
    earlier files). ``folder`` must be a URI that all executors can write to. Null texts hold the end id only.
    Documents that share a key keep all their rows, ordered by their text.
    """
    fresh(docs, key, text)
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    # A row per file, few thousands at most; collecting them is what makes the files exist once.
    made = sorted(
        dealt.mapInArrow(written(path, folder), "part bigint, file string, docs bigint, ids bigint, size bigint").collect()
    )
    out, before = [], 0
    for r in made:
        out.append((*r, before))
        before += r["ids"]
    return spark.createDataFrame(out, "part bigint, file string, docs bigint, ids bigint, size bigint, before bigint")


def read_back(batches):
    """One row per record of the files that a batch names, checksums tested, found through the index."""
    names = ["key", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
            files, base = fs.FileSystem.from_uri(name)
            with files.open_input_file(base + ".idx") as index, files.open_input_file(base + ".rec") as data:
                size = data.size()
                while chunk := index.read(struct.calcsize(ENTRY) * 4096):
                    entries = list(struct.iter_unpack(ENTRY, chunk))
                    rows = []
                    for k, (doc, at, start) in enumerate(entries):
                        data.seek(at)
                        length, _ = struct.unpack(HEAD, data.read(struct.calcsize(HEAD)))
                        data.seek(at)
                        payload, _ = unframed(data.read(16 + min(length, size)), 0)
                        key, ids = unpacked(payload)
                        if (key or 0) != doc:
                            raise ValueError(f"index and record differ in {name}")
                        rows.append((key, before + start, len(ids), zlib.crc32(ids.tobytes())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def read_records(files: DataFrame, key="doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every record of the files; a damaged record is an error."""
    n = max(1, files.count())
    rows = files.select("file", "before").repartition(n, "file")
    return rows.mapInArrow(
        read_back, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    ).withColumnRenamed("key", key)


def read_at(file: str, places: list[int]) -> list[tuple[int | None, list[int]]]:
    """(document id, ids) of the records at these places of one data file: a shuffled read."""
    files, base = fs.FileSystem.from_uri(file)
    out = []
    with files.open_input_file(base + ".rec") as data:
        for at in places:
            data.seek(at)
            length, _ = struct.unpack(HEAD, data.read(struct.calcsize(HEAD)))
            data.seek(at)
            payload, _ = unframed(data.read(16 + min(length, data.size())), 0)
            key, ids = unpacked(payload)
            out.append((key, ids.tolist()))
    return out


def run(spark, sf_dir):
    import public_tokenizers

    folder = new_folder(spark, "records")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    files = write_records(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_records(files)
