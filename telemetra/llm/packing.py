"""Best-fit packing planned over a histogram of lengths.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. Best-fit
decreasing runs over the counts per length (at most ``capacity`` of them), moving whole runs
of equal sequences at a time; its plan says, for ranks ``lo`` to ``hi`` within a length,
which sequences they fill and where. Pieces get their rank within their length from counts
per (writing task, length) and take their slots by a join on length and rank.

Defined cases: a null or empty text is one token, the closing id 0. Equal rows are packed
one by one; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from telemetra.llm.common import written

CAPACITY, END_ID = 2048, 0
# Chunks whose ids a Python worker keeps; beyond it that memory starts anew.
CACHE_CHUNKS = 600_000

PIECES = "doc bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"
PLAN = "length bigint, lo bigint, hi bigint, sequence bigint, offset bigint"


# Letters followed by ASCII marks (no apostrophe): always parted by the tokenizer, and not
# changed by normalization but for the lower case.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """Ids of whole texts as packed little-endian 32-bit numbers.

    The tokenizer drops white space and never joins what a blank or line feed parts, so a
    text's ids are those of its blank-separated chunks in order. Chunks repeat, and those of
    plain letters share their lower-case word; each word met is tokenized once, many in one
    call, and told apart by the tokens that end a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            ids = np.concatenate(self._ids([" ".join(part[k : k + 100]) for k in range(0, len(part), 100)]))
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                packed, at = ids.tobytes(), 0
                for word, end in zip(part, (4 * cut).tolist()):
                    self.known[word] = packed[at:end]
                    at = end
            else:  # a vocabulary without marks of word ends
                self.known |= {w: x.tobytes() for w, x in zip(part, self._ids(part))}

    def _learn(self, chunks: set[str]) -> None:
        known, words, rest, made = self.known, set(), set(), []
        for chunk in chunks:
            m = _PLAIN.fullmatch(chunk)
            if m is None:
                rest.add(chunk)
                continue
            word, marks = m.groups()
            word = word.lower()
            if word not in known:
                words.add(word)
            if marks not in known:
                rest.add(marks)
            if word != chunk:
                made.append((chunk, word, marks))
        plain = list(rest)
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            known.update(zip(part, (x.tobytes() for x in self._ids(part))))
        self._learn_words(list(words))
        for chunk, word, marks in made:
            known[chunk] = known[word] + known[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known = {"": b""}
        self._learn(set(chain.from_iterable(split)).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per Python worker, for all its tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with the writing task and the piece's number among the task's
    pieces of its length."""
    schema = pa.schema([("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(tokenizer_path), TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 200).columns)
                rows = []
                for doc, packed in zip(ids, words.encode([t or "" for t in texts])):
                    packed += end
                    for piece, start in enumerate(range(0, len(packed), 4 * capacity)):
                        own = packed[start : start + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, piece, start // 4, n, zlib.crc32(own), part, int(count[n])))
                        count[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, offset).

    Sequences with the same room left are runs of consecutive numbers. A length fills the
    runs of the least room that fits it, each sequence as often as it goes, then new
    sequences, so the plan's size depends on the lengths, not on the counts."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def put(start: int, n: int, room: int, times: int) -> None:
            nonlocal rank, left
            for k in range(times):
                plan.append((length, rank, rank + n, start, capacity - room + k * length))
                rank, left = rank + n, left - n
            if room > times * length:
                runs[room - times * length].append((start, n))

        while left:
            room = min((r for r, own in runs.items() if r >= length and own), default=capacity)
            start, n = runs[room].pop() if runs.get(room) else (opened, left)
            new = start == opened
            times = room // length
            full = min(n, left // times)
            used = full
            if full:
                put(start, full, room, times)
            if used < n and left:
                put(start + used, 1, room, min(left, times))
                used += 1
            if new:
                opened += used
            elif used < n:
                runs[room].append((start + used, n - used))
    return plan


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, ``piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity), "pack-pieces")
    cells = written(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-cells")
    # a row per length, at most `capacity`, reaches the driver
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit(counts, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local")).alias("d")
    # the plan is bounded by the lengths there are (see best_fit), whatever the corpus holds
    slot = (F.col("d.length") == F.col("p.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(plan.alias("p")), slot).select(
        F.col("doc").alias(id_col), "piece", "start", "d.length", "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )
