"""Passages that repeat across documents, by a hash-compared suffix sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import BASE2, RUN_BYTES, SLICE, Rolling, Words, bounds, mix, normal, ranges, raw, sliced, slices, words, words_sliced

#: Fewest words of a repeated passage: "over 50".
MIN_WORDS = 51
#: Words of an anchor, at most MIN_WORDS.
ANCHOR = 24
#: Different contexts of one anchor that are sorted in one task. Those of an anchor that has more go on window by window.
MOST_KINDS = 8192
#: Different contexts after which a table ends at the next anchor.
LEAST_KINDS = 2000


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i:i+w] for each i <= len(x) - w, in linear time."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor word, first and last window start that choose it, its hash), words counted from the document's first.

    Each window of ``length`` words chooses the leftmost of its word ``k``-grams with the least hash, so
    equal windows choose equal anchors at equal places.
    """
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    at = np.arange(n - k + 1)
    gram = mix(Rolling(w.hash, BASE2).of(at, at + k))
    key = (gram >> np.uint64(32)) << np.uint64(32) | at.astype(np.uint64)
    chosen = (sliding_least(key, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = w.doc()
    start = np.arange(len(chosen))
    start = start[doc[start] == doc[start + length - 1]]
    chosen = chosen[start]
    b = bounds(np.stack([doc[start].astype(np.int64), chosen], 1).view("i8,i8").ravel()) if len(start) else np.zeros(1, np.int64)
    lo, hi = start[b[:-1]], start[b[1:] - 1]
    a = chosen[b[:-1]]
    d = doc[a]
    base = w.first[:-1][d]
    return d, a - base, lo - base, hi - base, gram[a]


def _anchors(length: int, k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d, a, lo, hi, h = anchors(words(batch.column(1)), length, k)
        return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "doc_id": batch.column(0).take(pa.array(d)), "at": a.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    return sliced(run)


def _contexts(length: int):
    """Rows (doc_id, text, list of (h, at, lo, hi)) to a row for each of the list: the words lo to hi + length with single spaces, off = at - lo, m windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(batch.column(1), hashed=False)
        lists = batch.column(2)
        doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        s = lists.flatten()
        h, at, lo, hi = s.field(0), *(s.field(i).to_numpy() for i in (1, 2, 3))
        first = w.first[:-1][doc] + lo
        last = w.first[:-1][doc] + hi + length - 1
        text, _, begin = normal(w)
        flat = text.tobytes()
        ctx = pa.array([flat[x:y] for x, y in zip(begin[first].tolist(), (begin + w.end - w.start)[last].tolist())], pa.binary())
        return pa.RecordBatch.from_pydict({"h": h, "doc_id": batch.column(0).take(pa.array(doc)), "off": at - lo, "lo": lo, "m": hi - lo + 1, "ctx": ctx})

    return sliced(run)


class Suffixes:
    """Suffixes of sequences of verified word numbers, compared to a depth of ``length`` words."""

    def __init__(self, w: Words, length: int):
        self.length = length
        ids, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = inverse.astype(np.int64)
        self._verify(w, first)
        self.roll = Rolling(mix(self.word.astype(np.uint64) + np.uint64(1)))

    def _verify(self, w: Words, first: np.ndarray) -> None:
        """Words with equal hashes must have equal bytes; others of the same hash get numbers of their own."""
        size = w.end - w.start
        one = first[self.word]
        same = size == size[one]
        i = np.flatnonzero(same & (one != np.arange(len(one))))
        eq = w.buf[ranges(w.start[i], size[i])] == w.buf[ranges(w.start[one[i]], size[i])]
        ok = np.logical_and.reduceat(eq, np.cumsum(size[i]) - size[i]) if len(i) else np.zeros(0, bool)
        same[i] = ok
        seen: dict[bytes, int] = {}
        for j in np.flatnonzero(~same):
            b = w.buf[w.start[j] : w.end[j]].tobytes()
            self.word[j] = seen.setdefault(b, len(first) + len(seen))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at x and y share, up to length: binary search over hashes of extensions."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        for _ in range(int(self.length).bit_length()):
            mid = (lo + hi + 1) // 2
            eq = self.roll.of(x, x + mid) == self.roll.of(y, y + mid)
            lo, hi = np.where(eq, mid, lo), np.where(eq, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y, or equals it where or_equal."""
        c = self.common(x, y)
        full = c >= self.length
        step = np.where(full, 0, c)
        return np.where(full, or_equal, self.word[x + step] < self.word[y + step])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes ``at`` by suffix within runs of equal group: a bottom-up mergesort of all groups at once.

        In each round every suffix finds its rank in the neighbouring run by binary search.
        """
        n = len(at)
        order = np.arange(n)
        b = bounds(group)
        begin = np.repeat(b[:-1], np.diff(b))
        end = np.repeat(b[1:], np.diff(b))
        local = np.arange(n) - begin
        width = 1
        most = int(np.diff(b).max()) if n else 0
        while width < most:
            run = local // width
            right = run % 2 == 1
            other = np.minimum(begin + (run ^ 1) * width, end)
            stop = np.minimum(other + width, end)
            lo, hi = other.copy(), stop.copy()
            act = np.flatnonzero(lo < hi)
            while len(act):
                mid = (lo[act] + hi[act]) // 2
                # of equals, those of the left run come first
                before = self.less(at[order[mid]], at[order[act]], right[act])
                lo[act] = np.where(before, mid + 1, lo[act])
                hi[act] = np.where(before, hi[act], mid)
                act = act[lo[act] < hi[act]]
            place = begin + (run // 2) * 2 * width + local % width + (lo - other)
            merged = np.empty(n, np.int64)
            merged[place] = order
            order = merged
            width *= 2
        return order

    def repeats(self, at: np.ndarray) -> np.ndarray:
        """For neighbours in the sorted order: whether they share length words; the words are compared, not only hashes."""
        x, y = at[:-1], at[1:]
        same = self.common(x, y) >= self.length
        for i in np.array_split(np.flatnonzero(same), max(1, len(same) // 20_000)):
            span = np.arange(self.length)
            same[i] = (self.word[x[i][:, None] + span] == self.word[y[i][:, None] + span]).all(1)
        return same


def repeated_windows(h: np.ndarray, off: np.ndarray, m: np.ndarray, least: np.ndarray, most: np.ndarray, w: Words, length: int):
    """(context, first window, last window, least document) of stretches of windows that two documents at least have.

    Contexts are sorted by h and have different words or anchors. Each has m windows, the first of them off words
    before the anchor, and is in documents from least to most.
    """
    s = Suffixes(w, length)
    owner = np.repeat(np.arange(len(h)), m)  # context of each suffix
    step = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
    pos = w.first[:-1][owner] + step
    offset = off[owner] - step
    by = np.lexsort((offset, h[owner]))
    group = np.zeros(len(by), np.int64)
    a, b = by[1:], by[:-1]
    group[1:] = np.cumsum((h[owner][a] != h[owner][b]) | (offset[a] != offset[b]))
    srt = by[s.sort(pos[by], group)]
    # sort() keeps each suffix in its group's place
    same = s.repeats(pos[srt]) & (group[1:] == group[:-1])
    cls = np.concatenate([[0], np.cumsum(~same)])
    first = np.full(cls[-1] + 1, np.iinfo(np.int64).max)
    last = np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(first, cls, least[owner[srt]])
    np.maximum.at(last, cls, most[owner[srt]])
    hit = np.empty(len(by), bool)
    low = np.empty(len(by), np.int64)
    hit[srt], low[srt] = (first < last)[cls], first[cls]
    owner, step, low = owner[hit], step[hit], low[hit]
    # consecutive windows of a context become one stretch
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)
    b = np.append(np.flatnonzero(new), len(owner))
    return owner[b[:-1]], step[b[:-1]], step[b[1:] - 1], np.minimum.reduceat(low, b[:-1]) if len(low) else low


class Rows:
    """Contexts sorted by h, off and words. Of those that are alike in all three only the first's words are kept; the rows have 13 bytes each."""

    def __init__(self, batch: pa.RecordBatch, new: np.ndarray):
        c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.new, self.doc, self.lo = new, c["doc_id"].to_numpy().copy(), c["lo"].to_numpy().copy()
        kept = pa.array(np.flatnonzero(new))
        self.ctx = c["ctx"].take(kept)
        self.h, self.off, self.m = (c[x].take(kept).to_numpy() for x in ("h", "off", "m"))

    @property
    def size(self) -> np.ndarray:
        """Different contexts and their bytes."""
        return np.array([len(self.h), len(raw(self.ctx)[0])])

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        """All of parts, which follow one another."""
        out = cls.__new__(cls)
        for x in ("new", "doc", "lo", "h", "off", "m"):
            setattr(out, x, np.concatenate([getattr(p, x) for p in parts]))
        out.ctx = pa.chunked_array([p.ctx for p in parts]).combine_chunks()
        return out

    def spans(self, length: int):
        """Stretches of each row's windows that two documents at least have."""
        first = np.flatnonzero(self.new)
        w = words_sliced(self.ctx)
        kind, x, y, low = repeated_windows(self.h, self.off.astype(np.int64), self.m.astype(np.int64), np.minimum.reduceat(self.doc, first), np.maximum.reduceat(self.doc, first), w, length)
        n = np.bincount(kind, minlength=len(first))
        begin = np.cumsum(n) - n
        before = 0
        for i in range(0, len(self.doc), SLICE):
            doc, lo, new = (z[i : i + SLICE] for z in (self.doc, self.lo, self.new))
            of = before + np.cumsum(new) - 1
            before = of[-1] + 1
            at = ranges(begin[of], n[of])
            if len(at):
                lo = np.repeat(lo.astype(np.int64), n[of])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, n[of])), pa.array(lo + x[at]), pa.array(lo + y[at] + length), pa.array(low[at]), pa.nulls(len(at), pa.binary())], SPAN)

    def windows(self, length: int):
        """Each window of each row, with its words."""
        w = words(self.ctx, lower=False, hashed=False)
        flat = w.buf.tobytes()
        of = np.cumsum(self.new) - 1
        rows = np.cumsum(self.m[of] * np.diff(raw(self.ctx)[1])[of]) // SLICE
        b = bounds(rows)
        for i, j in zip(b[:-1], b[1:]):
            m = self.m[of[i:j]]
            step = ranges(np.zeros(j - i, np.int64), m)
            at = np.repeat(w.first[:-1][of[i:j]], m) + step
            start = np.repeat(self.lo[i:j].astype(np.int64), m) + step
            doc = np.repeat(self.doc[i:j], m)
            x, y = w.start[at], w.end[at + length - 1]
            c = bounds(np.cumsum(y - x) // SLICE)
            for p, q in zip(c[:-1], c[1:]):
                text = pa.array([flat[u:v] for u, v in zip(x[p:q].tolist(), y[p:q].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc[p:q]), pa.array(start[p:q]), pa.array(start[p:q] + length), pa.nulls(q - p, pa.int64()), text], SPAN)


SPAN = ["doc_id", "start", "end", "low", "words"]


def _sorted(length: int, most_kinds: int = MOST_KINDS):
    """Contexts sorted by h, off and words to stretches that repeat, and to the single windows of anchors with too many different contexts.

    Memory: the words of LEAST_KINDS + most_kinds contexts, or RUN_BYTES of them, and 13 bytes for each row of an anchor.
    """

    def run(batches):
        done: list[Rows] = []  # whole anchors
        last: list[Rows] = []  # the last anchor so far
        n_done = n_last = np.zeros(2, np.int64)  # their contexts and bytes
        key = off = None
        before = b""
        parted = False
        for batch in batches:
            for part in slices(batch, "ctx"):
                h, o = part.column(0).to_numpy(), part.column(2).to_numpy()
                body, at = raw(part.column(5))
                size = np.diff(at)
                new = np.ones(len(h), bool)
                i = 1 + np.flatnonzero((h[1:] == h[:-1]) & (o[1:] == o[:-1]) & (size[1:] == size[:-1]))
                if len(i):
                    eq = body[ranges(at[i], size[i])] == body[ranges(at[i - 1], size[i])]
                    new[i] = ~np.logical_and.reduceat(eq, np.cumsum(size[i]) - size[i])
                head = int(np.searchsorted(h, key, "right")) if key is not None and h[0] == key else 0
                if head and not parted:
                    new[0] = o[0] != off or body[: at[1]].tobytes() != before
                    last.append(Rows(part.slice(0, head), new[:head]))
                    n_last = n_last + last[-1].size
                    if n_last[0] > most_kinds or n_last[1] > RUN_BYTES:
                        yield from Rows.joined(last).windows(length)
                        last, n_last, parted = [], n_last * 0, True
                elif head:
                    yield from Rows(part.slice(0, head), new[:head]).windows(length)
                if head < len(h):
                    cut = int(bounds(h)[-2])
                    done += last
                    n_done = n_done + n_last
                    if cut > head:
                        done.append(Rows(part.slice(head, cut - head), new[head:cut]))
                        n_done = n_done + done[-1].size
                    if n_done[0] >= LEAST_KINDS or n_done[1] >= RUN_BYTES:
                        yield from Rows.joined(done).spans(length)
                        done, n_done = [], n_done * 0
                    last, parted = [Rows(part.slice(cut), new[cut:])], False
                    n_last = last[0].size
                key, off, before = h[-1], o[-1], body[at[-2] :].tobytes()
        if done or last:
            yield from Rows.joined(done + last).spans(length)

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR, most_kinds: int = MOST_KINDS) -> DataFrame:
    """Passages of at least min_words words that two documents or more have: (doc_id, start_word, end_word, first_doc).

    A row for each maximal stretch of a document's words in which every word lies in a window of min_words
    words that another document has too, word for word but for white space and ASCII case. Words are counted from 0 and
    end_word is exclusive. first_doc is the least doc_id that has any of the stretch's windows; dropping the
    rows' words where doc_id <> first_doc leaves a copy of each passage.

    Steps: (1) each window chooses an anchor, the k-gram of words with the least hash, so that equal windows
    have equal anchors; only anchors' hashes are shuffled. (2) Anchors that one document alone has are
    dropped. (3) The words around each anchor that is left meet by its hash, sorted, so that of equal ones, which
    are compared byte by byte, one is kept. The suffixes that begin at the windows are sorted there, to the depth
    of a window, by comparing hashes of common extensions, and neighbours in that order are compared word by
    word. (4) Where an anchor has more than most_kinds different surroundings, its windows go on one by one and
    meet by all their words. (5) Windows join to passages. Every document, word and window takes part; equal windows always
    have the same anchor, and all windows of an anchor go the same way, so the result is exact for any most_kinds.

    NULL and empty texts, and texts shorter than min_words, have no rows, nor do rows with a NULL doc_id.
    Repeats within one document only, or between rows that repeat a doc_id, don't count. Other columns are not looked at.
    """
    if not 0 < anchor_words <= min_words:
        raise ValueError("anchor_words must be from 1 to min_words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    found = docs.mapInArrow(_anchors(min_words, anchor_words), "h long, doc_id long, at int, lo int, hi int")
    w = Window.partitionBy("h")
    shared = found.select("*", F.min("doc_id").over(w).alias("x"), F.max("doc_id").over(w).alias("y")).where("x <> y")
    lists = shared.groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", "lo", "hi")).alias("found"))
    ctx = docs.join(lists, "doc_id").select("doc_id", "text", "found").mapInArrow(_contexts(min_words), "h long, doc_id long, off int, lo int, m int, ctx binary")
    spans = ctx.repartition("h").sortWithinPartitions("h", "off", "ctx").mapInArrow(_sorted(min_words, most_kinds), "doc_id long, start long, end long, low long, words binary")
    # stretches are done and only pass through, spread by doc_id
    w = Window.partitionBy("words", F.when(F.col("words").isNull(), F.col("doc_id")))
    spans = spans.select("doc_id", "start", "end", F.coalesce("low", F.min("doc_id").over(w)).alias("low"), F.max("doc_id").over(w).alias("y"), "words").where("words is null or low <> y").drop("y", "words")
    o = Window.partitionBy("doc_id").orderBy("start", "end")
    spans = spans.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    spans = spans.withColumn("no", F.sum(F.col("new").cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "no").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("low").alias("first_doc")).drop("no")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
win AS (SELECT doc_id, i AS s, array_to_string(w[i + 1 : i + 51], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 50)) AS i FROM t WHERE len(w) >= 51)),
shared AS (SELECT g, min(doc_id) AS low FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, s, low FROM win JOIN shared USING (g)),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 51 THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS no FROM marked)
SELECT doc_id, min(s) AS start_word, max(s) + 51 AS end_word, min(low) AS first_doc FROM span GROUP BY doc_id, no
"""
