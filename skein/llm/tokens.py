"""Token ids in directly addressable codes."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is longer than this is cut off before the pattern runs, whose look-ahead needs stack for each of its characters.
LONG_SPACE = 4096
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
CHUNK_BITS = 8
#: Bits between entries of a rank directory.
STRIDE = 512
MAGIC = b"DAC1"


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("skein", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Token ids of a text, special tokens being ordinary text.

    White space before other text is one piece but for its last character, and one piece at the end of a text. Nothing before it looks at it,
    so long white space is coded as that piece, and what lies between by the pattern: the ids are those of the whole text.
    """
    out: list[int] = []
    at = 0
    for m in SPACE.finditer(text):
        out += enc.encode_ordinary(text[at : m.start()])
        at = m.end() if m.end() == len(text) else m.end() - 1
        out += enc._encode_single_piece(text[m.start() : at])
    return out + enc.encode_ordinary(text[at:])


def encode(ids: np.ndarray, bits: int = CHUNK_BITS) -> bytes:
    """Directly addressable codes: the ids' lowest bits are level 0, the next those of the ids that have more, and so on.

    Layout, little endian: MAGIC, bits (u8), levels (u8), number of ids (u64); for each level its length (u64), the chunks (one byte or two
    each), the bitmap of ids that continue in the next level, and a rank directory, the bitmap's ones before each STRIDE bits (u64).
    """
    if not 1 <= bits <= 16:
        raise ValueError("bits must be from 1 to 16")
    rest = np.asarray(ids, np.uint64)
    kind = np.dtype("u1" if bits <= 8 else "<u2")
    levels = []
    n = len(rest)
    while len(rest):
        more = rest >> np.uint64(bits)
        go = more > 0
        bitmap = np.packbits(go, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(go)])[::STRIDE]
        levels.append(np.uint64(len(rest)).tobytes() + (rest & np.uint64((1 << bits) - 1)).astype(kind).tobytes() + bitmap.tobytes() + ones[: -(-len(rest) // STRIDE)].astype("<u8").tobytes())
        rest = more[go]
    return b"".join([MAGIC, bytes([bits, len(levels)]), np.uint64(n).tobytes(), *levels])


class Codes:
    """Random access to the ids of ``encode``; nothing is decoded but what is asked for."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("these are no directly addressable codes")
        self.bits, levels = blob[4], blob[5]
        self.n = int(np.frombuffer(blob, "<u8", 1, 6)[0])
        kind = np.dtype("u1" if self.bits <= 8 else "<u2")
        at = 14
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(blob, "<u8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(blob, kind, n, at)
            at += n * kind.itemsize
            bitmap = np.frombuffer(blob, "u1", -(-n // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(blob, "<u8", -(-n // STRIDE), at)
            at += 8 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << k * self.bits
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // STRIDE
            part = bitmap[block * STRIDE // 8 : (i >> 3) + 1].copy()
            part[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(part).sum())
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(0, np.uint64)
        for chunks, bitmap, _ in reversed(self.levels):
            go = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint64)
            here[go] |= out << np.uint64(self.bits)
            out = here
        return out


def token_codes(docs: DataFrame, vocabulary: str = VOCABULARY, bits: int = CHUNK_BITS) -> DataFrame:
    """Token ids of each document's whole text: (doc_id, n_tokens, codes), codes being ``encode`` of its ids.

    Text of special tokens is ordinary text. The ids decode to the text's bytes exactly. A NULL text has NULL n_tokens and codes,
    an empty one 0 tokens; repeated rows are coded each. Texts may be of any length, and so may their white space. vocabulary is the path of a rank file that every
    executor can read. Other columns are not looked at. No shuffle.
    """

    def run(batches):
        enc = encoding(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                ids = [None if t is None else ids_of(enc, t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([None if x is None else len(x) for x in ids], pa.int64()),
                    "codes": pa.array([None if x is None else encode(np.array(x, np.uint64), bits) for x in ids], pa.binary()),
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, codes binary")
