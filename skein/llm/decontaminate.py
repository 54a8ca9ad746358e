"""Documents that hold benchmark passages, by Wu-Manber search for many strings at once."""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOW_BYTES, mix, normal, ranges, sliced, view64, without, words

#: Words of a passage that must be found in a row. Shorter benchmark texts are searched for whole.
PASSAGE = 13
#: Benchmark texts of fewer words than this are not searched for.
LEAST = 1
#: Bytes of a block, at most.
BLOCK = 6
#: Strings of fewer bytes have tables of their own, as the shortest string bounds how far a search can skip.
SHORT = 24
TABLE_BITS = 20
#: Bytes of one set of tables, about. A larger benchmark is searched for in several passes.
MOST_BYTES = 96 << 20
#: Bytes of tables for each word of benchmark text.
WORD_BYTES = 24
#: Pairs of a place and a string that are compared at once.
PAIRS = 1 << 18


@dataclass
class Patterns:
    """Tables of Wu-Manber: how far to skip by the block that ends the search window, and which strings have such an end and beginning.

    String i is body[off[i] : off[i] + size[i]]; keys are the strings' ends and beginnings, hashed and sorted, member their numbers in that order.
    """

    body: np.ndarray
    off: np.ndarray
    size: np.ndarray
    item: np.ndarray
    window: int
    block: int
    shift: np.ndarray
    keys: np.ndarray
    member: np.ndarray


def block_hash(view: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    v = view[at] & LOW_BYTES[block]
    return (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def window_key(view: np.ndarray, at: np.ndarray, window: int, end: np.ndarray) -> np.ndarray:
    """The hash of the window's last block, and below it that of its first bytes."""
    return end.astype(np.uint64) << np.uint64(64 - TABLE_BITS) | mix(view[at] & LOW_BYTES[min(8, window)]) >> np.uint64(TABLE_BITS)


def _tables(body: np.ndarray, off: np.ndarray, size: np.ndarray, item: np.ndarray) -> Patterns:
    window = int(size.min())
    block = min(BLOCK, window)
    view = view64(body)
    shift = np.full(1 << TABLE_BITS, window - block + 1, np.int32)
    for q in range(window - block + 1):
        np.minimum.at(shift, block_hash(view, off + q, block), np.int32(window - block - q))
    keys = window_key(view, off, window, block_hash(view, off + window - block, block))
    order = np.argsort(keys, kind="stable")
    return Patterns(body, off, size, item, window, block, shift, keys[order], order.astype(np.int32))


def compile_patterns(items: list[tuple[int, str]], passage: int = PASSAGE, least: int = LEAST) -> list[Patterns]:
    """Tables for the passages of the items, those of one id being together. Passages are places in one copy of the texts."""
    if passage < 1:
        raise ValueError("a passage has a word at least")
    body, off, size, item = bytearray(), array("q"), array("i"), array("q")
    seen: set[bytes] = set()
    last = None
    for i, text in items:
        w = text.encode().lower().split()
        if len(w) < max(1, least):
            continue
        if i != last:
            seen, last = set(), i
        own = b" " + b" ".join(w) + b" "
        ends = [0, *np.cumsum([len(x) + 1 for x in w]).tolist()]
        for k in range(max(1, len(w) - passage + 1)):
            a, b = ends[k], ends[min(k + passage, len(w))] + 1
            s = own[a:b]
            if s not in seen:
                seen.add(s)
                off.append(len(body) + a)
                size.append(b - a)
                item.append(i)
        body += own
    flat, at, n, ids = np.frombuffer(bytes(body), np.uint8), np.array(off, np.int64), np.array(size, np.int32), np.array(item, np.int64)
    return [_tables(flat, at[some], n[some], ids[some]) for some in (n < SHORT, n >= SHORT) if some.any()]


def search(p: Patterns, flat: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(position, pattern) of every occurrence in flat. The text is cut into lanes that advance side by side,
    each over the windows that begin in it, so occurrences across lanes are found too."""
    none = np.zeros(0, np.int64)
    last = len(flat) - p.window
    if last < 0:
        return none, none
    view = view64(flat)
    at = np.arange(0, last + 1, lane)
    stop = np.minimum(at + lane, last + 1)
    found: list[np.ndarray] = []
    while len(at):
        step = p.shift[block_hash(view, at + p.window - p.block, p.block)]
        hit = at[step == 0]
        if len(hit):
            found.append(hit)
        at = at + np.maximum(step, 1)
        go = at < stop
        at, stop = at[go], stop[go]
    if not found:
        return none, none
    pos = np.concatenate(found)
    key = window_key(view, pos, p.window, block_hash(view, pos + p.window - p.block, p.block))
    low = np.searchsorted(p.keys, key, side="left")
    count = np.searchsorted(p.keys, key, side="right") - low
    some = np.flatnonzero(count)
    pos, low, count = pos[some], low[some], count[some]
    out = []
    part = np.cumsum(count) // PAIRS
    for i in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(part)) + 1):
        pat = p.member[ranges(low[i], count[i])].astype(np.int64)
        where = np.repeat(pos[i], count[i])
        size = p.size[pat].astype(np.int64)
        ok = where + size <= len(flat)
        where, pat, size = where[ok], pat[ok], size[ok]
        if len(where):
            eq = flat[ranges(where, size)] == p.body[ranges(p.off[pat], size)]
            ok = np.logical_and.reduceat(eq, np.cumsum(size) - size)
            out.append((where[ok], pat[ok]))
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (none, none)


def _searched(tables: Broadcast):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, begin, _ = normal(words(batch.column(1), hashed=False))
        doc, item, off = [], [], []
        for p in tables.value:
            pos, pat = search(p, flat)
            doc.append(np.searchsorted(begin, pos, side="right") - 1)
            item.append(p.item[pat])
            off.append(p.off[pat])
        # an item's passage is told by its place in the tables' text
        found = np.unique(np.stack([np.concatenate(x) for x in (doc, item, off)], axis=1), axis=0)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(found[:, 0])), "item_id": found[:, 1], "pattern": found[:, 2]})

    return sliced(run)


def contaminated(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, least: int = LEAST) -> DataFrame:
    """Benchmark items that documents quote: (doc_id, item_id, n_passages), a row for each pair.

    A document quotes an item if it has ``passage`` words of it in a row (all its words, where it has
    fewer), up to white space and ASCII case; n_passages counts the item's distinct such passages in it.
    Items of fewer than ``least`` words, 1 by default, are not searched for; an item of one common word is quoted by every document with that word.

    The benchmark is not the corpus and stays small, but its size is checked: tables of MOST_BYTES are made at a
    time, and a larger benchmark is searched for in several passes over the documents. Tables are broadcast to each worker once.

    NULL and empty texts quote nothing; rows with a NULL doc_id or item_id are left out; rows that repeat a
    doc_id count as one document, items that repeat an item_id as one item. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, pattern long")
    batch: list[tuple[int, str]] = []
    held = n = 0

    def added(out: DataFrame) -> DataFrame:
        tables = compile_patterns(batch, passage, least)
        if not tables:
            return out
        found = docs.mapInArrow(_searched(docs.sparkSession.sparkContext.broadcast(tables)), "doc_id long, item_id long, pattern long")
        return out.union(found.select("doc_id", "item_id", F.xxhash64(F.lit(n), "pattern").alias("pattern")))

    for row in items.distinct().orderBy("item_id", "text").toLocalIterator():
        # items of one id stay together, so that their passages are counted once
        if held > MOST_BYTES and row.item_id != batch[-1][0]:
            out = added(out)
            batch, held, n = [], 0, n + 1
        batch.append((row.item_id, row.text))
        held += len(row.text.encode()) + WORD_BYTES * len(row.text.split())
    if batch:
        out = added(out)
    return out.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_passages"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that quote no benchmark item. Columns stay."""
    return without(docs, contaminated(docs, benchmark, **options).select("doc_id"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) >= 1)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n))
SELECT g.doc_id, p.item_id, count(*) AS n_passages FROM g JOIN p ON g.n = p.n AND g.g = p.g GROUP BY ALL
"""
