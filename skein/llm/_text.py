"""Columnar text helpers for the operators of this subpackage.

Everything works on Arrow batches turned into numpy arrays: the bytes of many documents lie in one
buffer, and words, hashes and n-grams of all of them are found with whole-array operations.

Words are maximal runs of bytes that are not ASCII white space, lower-cased in ASCII only, i.e.
``text.encode().lower().split()``. A NULL text has no words, like an empty one.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are handled at once. Larger documents are handled alone, whole.
SLICE = 1 << 18
#: Bytes of text after which ``runs`` ends a table at the next key. Runs of one key are never parted.
RUN_BYTES = 1 << 26

BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Moduli of the polynomial hashes. Modulo a power of two, texts like the Thue-Morse sequence and its complement would collide for every base.
PRIMES = (2**31 - 1, 2**31 - 19)

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**i mod prime for i < n at least."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, SLICE):
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)])
        _powers[base, prime] = have
    return have


class Rolling:
    """Prefix polynomial hashes of a sequence of 64-bit values, modulo two primes.

    ``of(i, j)`` is the hash of values[i:j] for arrays of positions, in constant time each.
    """

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        self.parts = []
        for p in PRIMES:
            prefix = np.zeros(n + 1, np.uint64)
            # sums of numbers below 2**31 don't overflow
            np.cumsum(values % np.uint64(p) * powers(base % p, p, n + 1)[:n] % np.uint64(p), dtype=np.uint64, out=prefix[1:])
            self.parts.append((np.uint64(p), prefix, powers(pow(base, -1, p), p, n + 1)))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        one, two = ((prefix[j] - prefix[i]) % p * inv[i] % p for p, prefix, inv in self.parts)
        return one << np.uint64(32) | two


def view64(a: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number; the array is padded."""
    padded = np.concatenate([a, np.zeros(8, np.uint8)])
    return np.ndarray(len(a), "<u8", padded.tobytes(), strides=(1,))


#: Masks of a number's lowest 0 to 8 bytes.
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings buf[start:end], none empty: sums of mixed blocks of 8 bytes, each mixed with its number, and of the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(start, n) + (k << 3)
    left = np.minimum(np.repeat(end, n) - at, 8)
    number = mix(np.arange(1, int(n.max()) + 1, dtype=np.uint64) * np.uint64(BASE))
    blocks = mix((view64(buf)[at] & LOW_BYTES[left]) ^ number[k])
    return mix(np.add.reduceat(blocks, first) + size.astype(np.uint64) * np.uint64(BASE2))


@dataclass
class Words:
    """Words of a slice of documents. first has one entry more than there are documents."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def words(column: pa.Array, lower: bool = True, hashed: bool = True) -> Words:
    """Words of each row, with a 64-bit hash of each word's bytes."""
    buf, off = raw(column)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    white = WHITE[buf]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = white[:-1]
    after[:-1] = white[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~white & before)
    end = np.flatnonzero(~white & after) + 1
    first = np.searchsorted(start, off)
    h = spans_hash(buf, start, end) if hashed else np.zeros(0, np.uint64)
    return Words(buf, start, end, first, h)


def words_sliced(column: pa.Array, most: int = SLICE) -> Words:
    """``words`` of a column of any size: what is needed on the way is made for about ``most`` bytes at a time."""
    batch = pa.RecordBatch.from_arrays([column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column], ["text"])
    parts = [words(p.column(0)) for p in slices(batch, most=most)]
    if len(parts) < 2:
        return parts[0] if parts else words(column)
    byte = np.cumsum([0, *(len(p.buf) for p in parts)])
    word = np.cumsum([0, *(len(p.hash) for p in parts)])
    join = lambda name, shift: np.concatenate([getattr(p, name) + b for p, b in zip(parts, shift)])
    first = np.concatenate([*(p.first[:-1] + b for p, b in zip(parts, word)), word[-1:]])
    return Words(np.concatenate([p.buf for p in parts]), join("start", byte), join("end", byte), first, np.concatenate([p.hash for p in parts]))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-gram of words; a document of 1 to n-1 words has one, all of it."""
    size = np.diff(w.first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(w.n_docs), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][doc]
    end = w.first[1:][doc]
    h = np.zeros(len(doc), np.uint64)
    for i in range(n):
        part = mix(h * np.uint64(BASE) + w.hash[np.minimum(at + i, end - 1)])
        h = part if i == 0 else np.where(at + i < end, part, h)
    return doc, h


def normal(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as " word word ... word " one after another, where each begins (and the last ends), and where each word begins."""
    n = w.n_docs
    size = w.end - w.start
    at = np.cumsum(size + 1) - size + w.doc()
    total = np.concatenate([[0], np.cumsum(size + 1)])
    begin = total[w.first] + np.arange(n + 1)
    inside = np.ones(int(begin[-1]), bool)
    inside[at + size] = False
    inside[begin[:-1]] = False
    out = np.full(len(inside), 32, np.uint8)
    out[inside] = w.buf[~WHITE[w.buf]]
    return out, begin, at


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def sliced(f: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable:
    """Function for mapInArrow that applies f to slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield f(part)

    return run


def runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 2_000, most: int = RUN_BYTES) -> Iterator[pa.Table]:
    """Tables with whole runs of equal keys, of batches that are sorted by key: of about ``least`` rows or ``most`` bytes of text, whichever comes first.

    A longer run is not parted. Its texts may be too long for one chunk: read a table batch by batch, not combined.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        values = column.to_numpy(zero_copy_only=False)
        cuts = bounds(values)[:-1]
        if held and held[-1].column(batch.schema.get_field_index(key))[-1] == column[0]:
            cuts = cuts[1:]
        upto = np.zeros(batch.num_rows + 1, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        for c in cuts.tolist():
            if rows + c - at >= least or size + upto[c] - upto[at] >= most:
                if c > at:
                    held.append(batch.slice(at, c - at))
                yield pa.Table.from_batches(held)
                held, at, rows, size = [], c, 0, 0
        held.append(batch.slice(at))
        rows, size = rows + batch.num_rows - at, size + upto[-1] - upto[at]
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] numbers, then the next."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that the session shares.

    Only where the session names none, and Spark runs locally, is a temporary folder used.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="skein-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs but those whose doc_id is in the one column of gone. Columns stay, whatever their names."""
    name = fresh(docs, "__gone")
    return docs.join(gone.toDF(name).distinct(), docs["doc_id"].cast("long") == F.col(name), "left_anti")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
