"""Training windows packed by best-fit decreasing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import cut, slices
from .tokens import VOCABULARY, encode, encoding, ids_of

#: Tokens of a window.
CAPACITY = 2048


class Tree:
    """Segment tree over remaining capacities: how many windows are open at each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.leaves
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, least: int) -> int | None:
        """Smallest remaining capacity >= least of an open window."""
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


@dataclass
class Plan:
    """Where pieces go: those of length[e] with rank from first[e] go, each[e] to a window, to windows from window[e] on, from token at[e]."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    window: np.ndarray
    at: np.ndarray
    windows: int


def best_fit_decreasing(sizes: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing of sizes[length] pieces of each length <= capacity.

    Pieces of a length are alike, and so are windows of equal room, so both are handled in runs: the result is that of
    placing one piece after another, and the work depends on capacity, not on the number of pieces. When
    a piece goes to the tightest window, the next of its length goes there too as long as it fits.
    """
    tree = Tree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first window, number)
    windows = 0
    out: list[tuple[int, int, int, int, int]] = []

    def put(room: int, first: int, n: int) -> None:
        if room:
            open_.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(sizes, reverse=True):
        rank, left = 0, sizes[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                n = -(-left // (room // length))
                first = windows
                windows += n
            else:
                first, n = open_[room].pop(0)
                if not open_[room]:
                    del open_[room]
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            n, first = n - full, first + full
            if n and left:  # fewer than would fill the window
                out.append((length, rank, left, first, capacity - room))
                put(room - left * length, first, 1)
                left, n, first = 0, n - 1, first + 1
            if n and room < capacity:
                open_.setdefault(room, []).insert(0, (first, n))
                tree.add(room, n)
    return Plan(*np.array(out, np.int64).reshape(-1, 5).T, windows)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, token that it begins at) of pieces, by length and rank among those of the length."""
    order = np.lexsort((plan.first, plan.length))
    pl, pf = plan.length[order], plan.first[order]
    base = np.int64(pf.max() + rank.max(initial=0) + 2) if len(pf) else np.int64(1)
    e = order[np.searchsorted(pl * base + pf, length * base + rank, side="right") - 1]
    k = rank - plan.first[e]
    return plan.window[e] + k // plan.each[e], plan.at[e] + k % plan.each[e] * length


def _placed(plan: Plan):
    def run(batches):
        for b in batches:
            window, at = place(plan, b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(at), *b.columns[2:]], ["window_id", "at", *b.schema.names[2:]])

    return run


def _cut_up(capacity: int, vocabulary: str):
    def run(batches):
        enc = encoding(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                doc, start, size, codes = [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if not text:
                        continue
                    ids = np.array([*ids_of(enc, text), enc.n_vocab], np.uint64)
                    for at in range(0, len(ids), capacity):
                        part = ids[at : at + capacity]
                        doc.append(i)
                        start.append(at)
                        size.append(len(part))
                        codes.append(encode(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(codes, pa.binary())], ["doc_id", "start", "n_tokens", "codes"])

    return run


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Windows for pieces (doc_id, start, n_tokens, codes) of at most capacity tokens each: (window_id, at, doc_id, start, n_tokens, codes).

    A row for each piece, which lies in the window from token at. Pieces are packed by best-fit
    decreasing over all of them, longest first, those of equal length in the order of the rows. window_id counts from 0 without gaps.

    Pieces are numbered by length within each partition of the checkpointed input, and partitions' counts give the offsets, so
    neither a length nor a document that many rows have meets in one task. What the driver holds is the number of pieces of each length, capacity numbers
    at most, and the plan made of it. Pieces of 0 or NULL tokens are left out. Rows with a NULL doc_id, and repeated rows, are packed like others, each.
    """
    pieces = cut(pieces.where("n_tokens > 0"))
    n = F.monotonically_increasing_id()  # of checkpointed rows: the same each time
    pieces = pieces.select("*", n.alias("__row"), F.shiftright(n, 33).alias("__part"))
    counts = cut(pieces.groupBy("n_tokens", "__part").agg(F.count("*").alias("c")))
    sizes = {r.n_tokens: r.c for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # capacity rows at most
    if max(sizes, default=0) > capacity:
        raise ValueError("a piece is longer than a window")
    plan = best_fit_decreasing(sizes, capacity)
    before = Window.partitionBy("n_tokens").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("n_tokens", "__part").orderBy("__row")
    ranked = pieces.withColumn("__n", F.row_number().over(own)).join(offsets, ["n_tokens", "__part"])
    ranked = ranked.select("n_tokens", (F.col("__before") + F.col("__n") - 1).alias("rank"), "doc_id", "start", F.col("n_tokens").alias("n"), "codes")
    return ranked.mapInArrow(_placed(plan), "window_id long, at long, doc_id long, start long, n_tokens long, codes binary")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Training windows of docs' whole texts: (window_id, at, doc_id, start, n_tokens, codes), a row for each piece of a document.

    Each document is its token ids and one separator, the first id beyond the vocabulary. Documents of more than capacity tokens are
    first cut into full windows, and what is left of all documents is packed by ``packed``. The piece's n_tokens ids are those of the document from start;
    codes holds them as ``tokens.encode`` does, so a window is its rows' codes in the order of at.

    Empty and NULL texts have no window; rows with a NULL doc_id, and repeated rows, are packed each. Texts may be of any length. Other columns are
    not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return packed(docs.mapInArrow(_cut_up(capacity, vocabulary), "doc_id long, start long, n_tokens long, codes binary"), capacity)
