"""Word hashes over raw UTF-8 bytes in numpy, and a bounded frequency sketch that gives a global rarity order.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's 64-bit hash mixes its bytes eight at a time; those
of more than LONG bytes have one that is polynomial over them.
The sketch adds up occurrences in SKETCH buckets whatever the corpus size; order is (bucket count, hash), a total order that
every task computes alike. A filter by prefix is exact under any total order; the sketch only makes it selective.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_chunks, small_batches, text_bytes, with_ids

SKETCH_BITS = 18
SLICES = 8
_rng = np.random.default_rng(7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _rng.integers(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
#: Bytes of a word from which on it isn't hashed eight at a time.
LONG = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown on demand."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        got = _powers[int(base)] = np.multiply.accumulate(x)
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the text that holds it."""
    word = (data != 32) & ((data - np.uint8(9)) > 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[bounds <= len(data)]] = True
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, bounds)
    return starts, ends, np.repeat(np.arange(-1, len(bounds)), np.diff(at, prepend=0, append=len(starts)))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of each word, and the index of its text."""
    starts, ends, of = word_spans(data, bounds)
    low = np.zeros(len(data) + 8, np.uint8)
    np.add(data, ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=low[: len(data)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), low.data, strides=(1,))
    size = ends - starts
    h = mixed((size.astype(np.uint64) * _BASE) ^ (eight[starts] & _LOW_BYTES[np.minimum(size, 8)]))
    on, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(on):
        h[on] = mixed(h[on] * _BASE + (eight[starts[on] + k] & _LOW_BYTES[np.minimum(size[on] - k, 8)]))
        k += 8
        on = on[size[on] > k]
    far = np.flatnonzero(size > LONG)
    if len(far):
        edges = np.concatenate([[0], np.cumsum(size[far])])
        own = data[np.repeat(starts[far] - edges[:-1], size[far]) + np.arange(edges[-1])]
        h[far] = span_hashes(prefix_sums(own, _BYTE_LOWER), edges[:-1], edges[1:])
    return h, starts, of


def shingle_hashes(h: np.ndarray, of: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` words in a row within a text, and each text's bounds in them; a shorter text's words are one."""
    counts = np.bincount(of, minlength=n_texts) if len(of) else np.zeros(n_texts, np.int64)
    ends = np.cumsum(counts)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.repeat(ends - counts, made) + (np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made))
    length = np.repeat(np.minimum(counts, size), made)
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        inside = length > k
        out[inside] = out[inside] * np.uint64(0xA0761D6478BD642F) + h[begin[inside] + k]
    return mixed(out), np.concatenate([[0], np.cumsum(made)])


def bucket(h: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def frequency_sketch(spark: SparkSession, docs: DataFrame, hashes_of, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts per bucket over all texts. Each task sends 2 ** bits numbers, and the driver gets as many, whatever the input."""
    small_batches(spark)
    width = (1 << bits) // SLICES

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for chunk in in_chunks(batch, "text"):
                total += np.bincount(bucket(hashes_of(*text_bytes(chunk.column("text"))), bits), minlength=1 << bits)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in total.reshape(SLICES, width)], pa.binary())], ["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])

    made = with_ids(docs, "text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    out = np.zeros((SLICES, width), np.int64)
    for row in made.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


FILTER_BITS = 23


def id_filter(ids: DataFrame) -> np.ndarray:
    """One column of longs -> a bitmap of 2 ** FILTER_BITS bits, the same size for any number of ids. A clear bit rules an id out;
    a set bit rules nothing in, so what passes is joined exactly afterwards."""
    name = ids.columns[0]
    width = (1 << FILTER_BITS) // 8 // SLICES

    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy()
            bits[filter_place(x)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.packbits(bits).reshape(SLICES, width)], pa.binary())], ["slice", "bits"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "bits"])

    out = np.zeros((SLICES, width), np.uint8)
    for row in ids.select(name).mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary").collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def filter_place(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def passes_filter(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which of a column's ids the bitmap doesn't rule out; nulls are."""
    at = filter_place(ids.fill_null(0).to_numpy())
    return ((bits[at >> 3] >> (7 - (at & 7))) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
