"""Words and word hashes of whole Arrow text columns at once, in numpy."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64(0xD6E8FEB86659FD93)
PRIME_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def byte_table(word_byte):
    """(is a word byte, byte in lower case) for each of the 256 bytes; A-Z become a-z first."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return np.array([word_byte(int(b)) for b in lower], dtype=bool), lower


#: Letters a-z, digits and everything beyond ASCII.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Everything but the six ASCII white-space characters.
SOLID = byte_table(lambda b: b != 32 and not 9 <= b <= 13)


def slices(batches, text, most=SLICE_BYTES):
    """Pieces of record batches with about ``most`` bytes of text each; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def raw(column):
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x):
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * PRIME
    return x ^ (x >> np.uint64(32))


class Words:
    """All words of a text column: ``data`` in lower case, ``start`` and ``stop`` bytes, ``first`` word of each text."""

    def __init__(self, column, table):
        is_word, lower = table
        data, offsets = raw(column)
        solid = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1] if len(data) else solid
        after = np.concatenate([solid[1:], [False]]) & ~edge[1:] if len(data) else solid
        self.data = lower[data]
        self.start = np.flatnonzero(solid & ~before)
        self.stop = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self):
        """64-bit hash of each word: a polynomial in a random value per byte, from prefix sums."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.uint64)
        values = mixed(np.arange(1, 257, dtype=np.uint64))[self.data]
        powers = np.full(n, PRIME)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64)])
        back = np.full(n, PRIME_INVERSE)
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        return mixed((sums[self.stop] - sums[self.start]) * back[self.start])

    def text(self, i, n):
        """Words i to i + n - 1, joined by one space."""
        return " ".join(
            self.data[a:b].tobytes().decode() for a, b in zip(self.start[i : i + n], self.stop[i : i + n])
        )


def grams(hashes, k):
    """Hash of every k neighbouring words, without regard to where texts end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * PRIME + hashes[j : j + n]
    return mixed(out)


def owners(first, n):
    """Number of the text of each of n words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
