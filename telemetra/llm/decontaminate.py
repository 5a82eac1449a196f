"""Benchmark decontamination by latent semantic retrieval.

Texts become words, and words numbers of the benchmark's vocabulary (other words have none;
they weigh on a passage's length in the decomposition only, so their synonyms are out of
reach). A randomised singular value decomposition of the
TF-IDF matrix of all passages of the corpus, ``PASSAGE`` words each, gives every term a
vector: two distributed passes compute (A'A)·Ω and (A'A)·Q as sums per term, and only
terms × ``RANK`` numbers, bounded by the benchmark, reach the driver. In the search each
window of ``WINDOW`` words of every text is held against each window of the benchmark items
by the cosine of their known words in that space, which does not depend on the size of the
corpus; pairs are left out only where the text around has fewer words of the item than the
verdict below needs. Windows above ``COSINE`` are candidates; around each, the longest common subsequence of words with
the whole item decides, together with the item's answer (its last sentence) for paraphrases.

Defined cases: null or empty texts and items match nothing. A document with an item several
times gives one row for it, the best place. Repeated rows are judged alike; an empty corpus
or benchmark gives an empty result; further columns pass through :func:`keep_clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import written

PASSAGE, WINDOW = 32, 12
RANK, SPARE, SEED = 40, 8, 11
# One in ``KNOWN`` words of a window must be in the vocabulary.
COSINE, KNOWN = 0.7, 3
# (word, item) pairs and words of the decomposition that a task holds at a time; texts that it
# numbers in one go.
PAIRS, PIECE, TEXTS = 1_000_000, 1 << 15, 256
# Part of an item's words, its most frequent ones, that the first count of words passes over.
FREQUENT = 0.2
# Part of an item's words found in order: enough alone, or enough with the whole answer.
SAME, SAME_WITH_ANSWER = 0.75, 0.5
# Words of an answer at most; an item without a sentence end before it has its last quarter.
ANSWER_WORDS = 12

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def answer_of(text: str) -> list[str]:
    """Words of the last sentence, or the last quarter of an item that is one sentence."""
    parts = [p for p in (words_of(s) for s in _SENTENCE.split(text)) if p]
    if len(parts) > 1:
        return parts[-1][-ANSWER_WORDS:]
    words = words_of(text)
    return words[-max(1, min(ANSWER_WORDS, len(words) // 4)) :]


class Vocabulary:
    """Words of the benchmark items; ids of texts, -1 for any other word."""

    def __init__(self, items: list[tuple]):
        self.items = [(key, text) for key, text in items if words_of(text)]
        self.number: dict[str, int] = {}
        for _, text in self.items:
            for w in words_of(text):
                self.number.setdefault(w, len(self.number))

    def ids(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int32, count=len(words))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def word_numbers(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, ids`` per document: the numbers of all its words, in order. The last one of a
    task also has ``counts``: the passages per term, and in all, that the task met."""
    key = F.col(id_col) if id_col else F.lit(None).cast("bigint")
    rows = docs.select(key.alias("_id"), F.col(text_col).cast("string").alias("text"))
    size, many = len(vocabulary.number), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held = np.zeros(size + 1, dtype=np.int64), None

        def batch_of(key: pa.Array, ids: pa.Array, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, ids, pa.array([None] * (len(key) - len(counts)) + counts, many)], names=["_id", "ids", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = _lists([vocabulary.ids(t) for t in part.column(1).to_pylist()])
                for flat, passage, n in _passages(ids):
                    count[size] += n
                    known = flat >= 0
                    pair = np.unique(passage[known] * size + flat[known])
                    count[:size] += np.bincount(pair % size, minlength=size)
                if held:
                    yield batch_of(*held, [])
                held = part.column(0), ids
        if held:
            yield batch_of(*held, [count.tolist()])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "text").mapInArrow(run, f"_id {kind}, ids array<int>, counts array<bigint>")


def _passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The word numbers of a column of texts in pieces of whole passages: numbers, the passage
    of each, and how many passages there are. Pieces hold ``PIECE`` words or few more, so that
    a word's cost does not grow with the batch it comes in (larger arrays leave the cache)."""
    every = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        # a text's passages start at its first word: cut between texts, or inside a long one
        text = int(np.searchsorted(offsets, at, side="right")) - 1
        upto = int(np.searchsorted(offsets, at + PIECE, side="right")) - 1
        stop = int(offsets[upto]) if offsets[upto] > at else min(int(offsets[text + 1]), at + PIECE)
        heads = offsets[text : np.searchsorted(offsets, stop, side="left")].astype(np.int64)
        heads[0] = at
        sizes = np.diff(np.append(heads, stop))
        inside = np.arange(stop - at) - np.repeat(heads - at, sizes)
        per = -(-sizes // PASSAGE)
        yield every[at:stop], np.repeat(np.cumsum(per) - per, sizes) + inside // PASSAGE, int(per.sum())
        at = stop


def document_frequencies(numbers: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Passages per term over the whole corpus, and the number of passages."""
    sums = numbers.select(F.posexplode("counts").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(size + 1, dtype=np.int64)
    for r in sums:
        found[r["term"]] = r["n"]
    return found[:size], int(found[size])


def gram_times(numbers: DataFrame, idf: np.ndarray, other: float, right: np.ndarray) -> np.ndarray:
    """(A'A)·``right`` for the corpus' TF-IDF passages A, each row scaled to its weight
    (words outside the vocabulary count with ``other``)."""
    size, width = right.shape
    shared = _broadcast(numbers, ((right * idf[:, None]).astype(np.float32), np.append(idf, other).astype(np.float32)))  # -1 is the last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, weights = shared.value
        out = np.zeros((size, width))
        for batch in batches:
            for flat, passage, n in _passages(batch.column(0)):  # A'A adds up over rows
                norm = np.bincount(passage, weights=np.square(weights[flat]), minlength=n)
                known = flat >= 0
                term, row = flat[known], passage[known]
                if not len(term):
                    continue
                new = np.concatenate([[True], row[1:] != row[:-1]])
                starts = np.flatnonzero(new)
                y = np.add.reduceat(weighted[term], starts, axis=0) / norm[row[starts]][:, None].astype(np.float32)
                number = np.cumsum(new) - 1
                order = np.argsort(term.astype(np.uint16) if size <= 1 << 16 else term, kind="stable")
                term = term[order]
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                out[term[first]] += np.add.reduceat(y[number[order]], first, axis=0)
        out *= idf[:, None]
        seen = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(list(out[seen]), pa.list_(pa.float64()))], names=["term", "v"])

    parts = numbers.select("ids").mapInArrow(run, "term bigint, v array<double>")
    sums = parts.groupBy("term").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v")).collect()
    found = np.zeros((size, width))
    for r in sums:
        found[r["term"]] = r["v"]
    return found


def _broadcast(df: DataFrame, value):
    """``value``, bounded by the benchmark, once per executor instead of in every task."""
    return df.sparkSession.sparkContext.broadcast(value)


class Index:
    """What the search needs: term vectors, words and windows of the items."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, vectors: np.ndarray):
        self.vocabulary = vocabulary
        self.vectors = np.append(vectors * idf[:, None], np.zeros((1, vectors.shape[1])), axis=0).astype(np.float32)  # -1 is the last
        self.item_ids = [vocabulary.ids(text) for _, text in vocabulary.items]
        self.answers = [[vocabulary.number[w] for w in answer_of(text)] for _, text in vocabulary.items]
        self.queries = [_unit(_sums(self.vectors[x], min(WINDOW, len(x)))) for x in self.item_ids]
        n = np.array([len(x) for x in self.item_ids])
        self.slack = np.maximum(4, n // 4)
        # of a part of ``span`` words at least ``least`` must be an item's, or no verdict accepts it
        self.span, self.least = n + 2 * self.slack, np.ceil(SAME_WITH_ANSWER * n).astype(np.int64)
        held = []
        for no, x in enumerate(self.item_ids):
            terms, times = np.unique(x, return_counts=True)
            order = np.argsort(idf[terms], kind="stable")
            # frequent words stand in most texts and items: without them so many fewer are needed
            passed = np.cumsum(times[order]) <= int(FREQUENT * len(x))
            self.least[no] -= times[order][passed].sum()
            held += [(t, no, k) for t, k in zip(terms[order][~passed], times[order][~passed])]
        term, self.item_at, self.times = (np.array(c, dtype=np.int64) for c in zip(*sorted(held)))
        self.n_items = np.append(np.bincount(term, minlength=len(vocabulary.number)), 0)
        self.first_item = np.cumsum(self.n_items) - self.n_items

    def parts(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): all places from where ``span`` words of the text hold
        ``least`` words of the item, runs of places together."""
        load = np.cumsum(self.n_items[ids])
        at = 0
        while at < len(ids):
            # pieces with a bounded number of (word, item) pairs, overlapping by the longest span
            end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + PAIRS)))
            yield from self._parts(ids[at : end + int(self.span.max())], at)
            at = end

    def _parts(self, ids: np.ndarray, at: int) -> Iterator[tuple[int, int, int]]:
        n = self.n_items[ids]
        place = np.repeat(np.arange(len(ids)), n)
        held = np.arange(len(place)) + np.repeat(self.first_item[ids] - (np.cumsum(n) - n), n)
        item = self.item_at[held]
        order = np.argsort(item.astype(np.uint16) if len(self.item_ids) <= 1 << 16 else item, kind="stable")
        item, place, held = item[order], place[order], held[order]
        upto = np.arange(len(item)) + self.least[item] - 1
        enough = np.flatnonzero(upto < len(item))
        enough = enough[item[upto[enough]] == item[enough]]
        enough = enough[place[upto[enough]] - place[enough] < self.span[item[enough]]]
        if not len(enough):
            return
        no, last = item[enough], place[enough]
        first = place[upto[enough]] - self.span[no] + 1
        cut = np.concatenate([[True], (no[1:] != no[:-1]) | (first[1:] > last[:-1] + 1)])
        start, stop = np.flatnonzero(cut), np.append(np.flatnonzero(cut)[1:], len(no)) - 1
        # repeats of a word count as often as the item has it
        begin, size = enough[start], upto[enough[stop]] + 1 - enough[start]
        run = np.repeat(np.arange(len(start)), size)
        words, count = np.unique(run * len(self.item_at) + held[np.arange(len(run)) + np.repeat(begin - (np.cumsum(size) - size), size)], return_counts=True)
        most = np.bincount(words // len(self.item_at), weights=np.minimum(count, self.times[words % len(self.item_at)]), minlength=len(start))
        for k in np.flatnonzero(most >= self.least[no[start]]):
            yield int(no[start[k]]), int(first[start[k]]) + at, int(last[stop[k]]) + at

    def candidates(self, ids: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """Per item: places where it would start, with the cosine that says so."""
        found: dict[int, list[tuple[int, float]]] = {}
        for no, first, last in self.parts(ids):
            queries, slack = self.queries[no], int(self.slack[no])
            size = min(WINDOW, len(self.item_ids[no]))
            # every window of the text that is a window of the item with a start in the run
            lo, hi = max(0, first + slack), min(len(ids) - size, last + slack + len(queries) - 1)
            for k in range(lo, hi + 1, 4096):
                part = ids[k : min(hi + 1, k + 4096) + size - 1]
                known = np.convolve(part >= 0, np.ones(size, dtype=np.int64), "valid")
                cos = _unit(_sums(self.vectors[part], size)) @ queries.T
                cos[known * KNOWN < size] = 0
                for i, j in zip(*np.nonzero(cos >= COSINE)):
                    if first + slack <= k + i - j <= last + slack:
                        found.setdefault(no, []).append((int(k + i - j), float(cos[i, j])))
        return found

    def matches(self, ids: np.ndarray) -> list[tuple[int, float, float, bool, int]]:
        """(item, cosine, share of its words in order, answer found, first word) per item
        that the text holds."""
        out = []
        for no, places in sorted(self.candidates(ids).items()):
            item, answer = self.item_ids[no], self.answers[no]
            best, done = None, set()
            slack = int(self.slack[no])
            for start, cos in sorted(places, key=lambda p: -p[1]):
                if start // slack in done:  # a place next to one that was looked at
                    continue
                done |= {start // slack}
                lo = max(0, start - slack)
                part = ids[lo : start + len(item) + slack].tolist()
                share = common(item.tolist(), part) / len(item)
                holds = any(part[i : i + len(answer)] == answer for i in range(len(part) - len(answer) + 1))
                if best is None or (share, holds) > best[1:3]:
                    best = (cos, share, holds, lo)
            if best[1] >= SAME or (best[2] and best[1] >= SAME_WITH_ANSWER):
                out.append((no, *best))
        return out


def _sums(v: np.ndarray, size: int) -> np.ndarray:
    """Sums of each ``size`` rows in a row."""
    sums = np.zeros((len(v) + 1, v.shape[1]))
    np.cumsum(v, axis=0, dtype=np.float64, out=sums[1:])
    return (sums[size:] - sums[:-size]).astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def build(numbers: DataFrame, vocabulary: Vocabulary, rank: int = RANK) -> Index:
    """Term vectors from the corpus: idf over all passages, then the randomised SVD."""
    size = len(vocabulary.number)
    seen, total = document_frequencies(numbers, size)
    idf = np.log((1 + total) / (1 + seen)) + 1e-3
    other = float(np.log(1 + total)) + 1e-3
    width = min(size, rank + SPARE)
    start = np.random.default_rng(SEED).standard_normal((size, width))
    q, _ = np.linalg.qr(gram_times(numbers, idf, other, start))
    core = q.T @ gram_times(numbers, idf, other, q)
    values, turn = np.linalg.eigh((core + core.T) / 2)
    top = np.argsort(-values)[: min(rank, size)]
    # sphered: each latent direction counts alike, or frequent words would decide
    scale = 1 / np.sqrt(np.maximum(values[top], 1e-9 * max(values.max(), 1e-30)))
    return Index(vocabulary, idf, (q @ turn[:, top]) * scale)


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[tuple]:
    """The stated query set: every item, held by each task of the search."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col).orderBy(item_col, text_col)
    return [tuple(r) for r in rows.collect()]


FOUND = "item_id bigint, cosine double, lcs_share double, answer_found boolean, first_word bigint"


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document, item) that the document holds."""
    vocabulary = Vocabulary(benchmark_items(benchmark))
    kind = docs.schema[id_col].dataType.simpleString()
    if not vocabulary.number:
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, {FOUND}")
    numbers = written(word_numbers(docs, vocabulary, id_col=id_col, text_col=text_col), "benchmark-words")
    index = build(numbers, vocabulary)

    shared = _broadcast(numbers, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            rows = []
            for i in range(batch.num_rows):
                for no, cos, share, holds, first in index.matches(flat[offsets[i] : offsets[i + 1]]):
                    rows.append((batch.column(0)[i].as_py(), index.vocabulary.items[no][0], cos, share, holds, first))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[id_col, "item_id", "cosine", "lcs_share", "answer_found", "first_word"])

    return numbers.select("_id", "ids").mapInArrow(run, f"{id_col} {kind}, {FOUND}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Pipeline form: the rows of ``docs`` that hold no benchmark item, all columns. Texts
    are judged in place by the index, which is bounded by the benchmark."""
    vocabulary = Vocabulary(benchmark_items(benchmark))
    if not vocabulary.number:
        return docs
    numbers = written(word_numbers(docs, vocabulary, id_col=None, text_col=text_col).select("ids", "counts"), "benchmark-words")
    index = build(numbers, vocabulary)
    at = docs.columns.index(text_col)
    shared = _broadcast(docs, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            clean = [not index.matches(index.vocabulary.ids(t)) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
