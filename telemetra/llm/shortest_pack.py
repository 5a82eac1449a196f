"""Shortest-pack-first packing over a histogram of lengths.

A document's ids are cut at every ``capacity`` ids; the full pieces are sequences of their
own, the tails make the histogram. Lengths are placed longest first, each into the packs
that are shortest so far, if it fits, else into new ones; a pattern (what a pack holds)
carries how many packs look alike, so the plan's size depends on the lengths, not on the
documents. Then, since cuts are free, packs that would be padded by ``LOOSE`` ids or more are
mended: the shortest of them give their tails up, which fill the gaps of the others, cut
where a gap ends, and a pack that still lacks an eighth is cut into sequences of powers of
two, which need no padding. Tails get their rank within their length from counts per (writing task,
length) and take their places by a join on length and rank.

Defined cases: a null or empty text is one id, the closing 0. Equal rows are packed one by
one; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm.common import written

CAPACITY, END_ID = 1024, 0
# Padding from which a pack is mended. It bounds the cuts of a tail, and so the plan.
LOOSE = 16
# Pieces whose ids a Python worker keeps; beyond it those met in one slice only are forgotten.
CACHE_PIECES = 250_000
# Bytes of text that are cut and looked up at a time.
SLICE = 2_000_000


# ---------------------------------------------------------------- ids

# A word with the blank before it, or white space up to the last character before a word:
# boundaries of these are boundaries of the byte-level pre-tokenizer too. To it the four
# separators U+001C to U+001F are no white space.
_CHUNK = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
# ASCII marks but the apostrophe: the pre-tokenizer always parts them from a letter or digit before.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_FEED, _GAP, _WORD, _MARK, _HIGH, _SPACE = 1, 2, 4, 8, 16, 32


def _kinds() -> np.ndarray:
    """What a UTF-8 byte may be: line feed, blank or line feed, letter or digit, mark, the first byte of
    white space beyond ASCII, other white space."""
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[[10, 32]] = _GAP
    kinds[10] |= _FEED
    kinds[[i for i in range(128) if chr(i).isalnum()]] = _WORD
    kinds[[ord(c) for c in _MARKS]] = _MARK
    kinds[[i for i in range(128) if chr(i).isspace() and chr(i) not in " \n"]] = _SPACE
    kinds[sorted({chr(i).encode()[0] for i in range(128, 0x3001) if chr(i).isspace()})] = _HIGH
    return kinds


_KINDS = _kinds()
_HIGH_SPACES = np.array(sorted(int.from_bytes(chr(i).encode().ljust(3, b"\0"), "big") for i in range(128, 0x3001) if chr(i).isspace()))


def _gathered(ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` ids from each ``begin`` on, one after another."""
    upto = np.cumsum(count)
    return ids[np.repeat(begin - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)]


class ChunkIds:
    """Ids of whole texts as packed little-endian 32-bit numbers, the same as the
    tokenizer's. Texts are cut at blanks, line feeds and marks behind a word, all at once;
    each piece met is tokenized once, many in one call, a line feed between them. A text
    with other white space is cut by a pattern; a tokenizer of another kind, or a text with
    an added token, is encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        splitter = kind.get("pre_tokenizer") or {}
        self.chunked = (kind.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True)
                        and not splitter.get("add_prefix_space") and len(self._ids(["\n"])[0]) == 1)
        self.added = [t["content"] for t in kind.get("added_tokens", ())]
        self.feed = self._ids(["\n"])[0] if self.chunked else None
        self._forget()

    def _forget(self) -> None:
        # number of each piece; where its ids begin in `ids`, how many they are, and how often it was looked up
        self.known: dict[bytes, int] = {}
        self.begin, self.count, self.times = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(1 << 20, dtype="<u4"), 0

    def _forget_rare(self) -> None:
        """Pieces looked up once go, or all where the others fill the memory."""
        pieces, often = list(self.known), np.flatnonzero(self.times > 1)
        begin, count, ids = self.begin[often], self.count[often], self.ids
        self._forget()
        if len(often) <= CACHE_PIECES // 2:
            self.known = {pieces[i]: n for n, i in enumerate(often.tolist())}
            ids = _gathered(ids, begin, count)
            self.begin, self.count, self.times = np.cumsum(count) - count, count, np.ones_like(count)
            self.ids, self.used = np.concatenate([ids, np.zeros(1 << 20, dtype="<u4")]), len(ids)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokenized(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that hold no line feed, one after another, and how many each has."""
        ids = np.concatenate(self._ids(["\n".join(chunks[k : k + 100]) + "\n" for k in range(0, len(chunks), 100)]))
        cut = np.flatnonzero(ids == self.feed[0])
        if len(cut) == len(chunks):
            return np.delete(ids, cut), np.diff(cut, prepend=-1) - 1
        each = self._ids(chunks)
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of pieces not met before: a chunk, a blank or line feed before it or not."""
        fed = np.array([p[:1] == b"\n" for p in pieces])
        for at in range(0, len(pieces), 5000):
            lines = fed[at : at + 5000]
            ids, count = self._tokenized([p.decode("utf-8", "surrogatepass").removeprefix("\n") for p in pieces[at : at + 5000]])
            begin = np.cumsum(count) - count
            ids = np.insert(ids, begin[lines], self.feed[0])
            count = count + lines
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.begin = np.append(self.begin, self.used + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.times = np.append(self.times, np.zeros_like(count))
            self.used += len(ids)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))

    def _odd(self, text: str) -> bytes:
        """A text with an added token, or with white space other than single blanks and line feeds between words."""
        if any(t in text for t in self.added):
            return self._ids([text])[0].tobytes()
        chunks = _CHUNK.findall(text)
        space = [c for c in chunks if c.isspace()]
        found = dict(zip(space, (x.tobytes() for x in self._ids(space)))) if space else {}
        new = [c.encode("utf-8", "surrogatepass") for c in dict.fromkeys(chunks) if c not in found]
        self._learn([c for c in new if c not in self.known])
        for c in new:
            n = self.known[c]
            found[c.decode("utf-8", "surrogatepass")] = self.ids[self.begin[n] : self.begin[n] + self.count[n]].tobytes()
        return b"".join(map(found.__getitem__, chunks))

    def _uneven(self, data: np.ndarray, start: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Texts, by number, whose white space is not blanks and line feeds each between two words,
        or that hold an added token."""
        gap = (kind & _GAP) != 0
        after = np.concatenate([[True], gap[:-1]])
        first = start[:-1][start[:-1] < start[1:]]
        after[first] = True
        ends = start[1:][start[:-1] < start[1:]] - 1
        last = ends[gap[ends]]
        high = np.flatnonzero(kind == _HIGH)
        two, three = (data[np.minimum(high + i, len(data) - 1)].astype(np.int64) for i in (1, 2))
        code = (data[high].astype(np.int64) << 16) | (two << 8)
        high = high[np.isin(code, _HIGH_SPACES) | np.isin(code | three, _HIGH_SPACES)]
        places = [np.flatnonzero(gap & after), last, np.flatnonzero(kind == _SPACE), high]
        held, found = data.tobytes(), []
        for token in self.added:
            token, at = token.encode(), -1
            while (at := held.find(token, at + 1)) >= 0:
                found.append(at)
        return np.unique(np.searchsorted(start, np.concatenate([*places, np.array(found, dtype=np.int64)]), "right") - 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return [x.tobytes() for x in self._ids(texts)]
        if len(self.known) > CACHE_PIECES:
            self._forget_rare()
        packed = [t.encode("utf-8", "surrogatepass") for t in texts]
        start = np.concatenate([[0], np.cumsum([len(p) for p in packed])])
        joined = b"".join(packed)
        data = np.frombuffer(joined, dtype=np.uint8)
        if not len(data):
            return [b""] * len(texts)
        kind = _KINDS[data]
        odd = set(self._uneven(data, start, kind).tolist())
        if odd:
            even = self.encode(["" if i in odd else t for i, t in enumerate(texts)])
            return [self._odd(t) if i in odd else even[i] for i, t in enumerate(texts)]
        bound = (kind & _GAP) != 0
        bound[1:] |= ((kind[1:] & _MARK) != 0) & ((kind[:-1] & _WORD) != 0)
        bound[start[:-1][start[:-1] < start[1:]]] = True
        at = np.append(np.flatnonzero(bound), len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(joined)]).dictionary_encode()
        different = pieces.dictionary.to_pylist()
        new = [p for p in different if p not in self.known]
        if new:
            self._learn(new)
        number = np.array([self.known[p] for p in different])
        self.times[number] += 1
        number = number[pieces.indices.to_numpy()]
        count = self.count[number]
        ids = _gathered(self.ids, self.begin[number], count).tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(count)])[np.searchsorted(at, start)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@functools.cache
def chunk_ids(path: str) -> ChunkIds:
    """One per Python worker, for all its tasks."""
    return ChunkIds(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows, about ``SLICE`` bytes of text at a time."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff((np.cumsum(size, dtype=np.int64) - size) // SLICE)) + 1
    for at, end in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        yield batch.slice(at, end - at)


PIECES = "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, local bigint, ids binary"


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every document's full pieces and its tail, with the writing task and the piece's number
    among the task's pieces of its length; a tail has its ids, should it be cut."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = chunk_ids(tokenizer_path), TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for some in _slices(batch):
                ids, texts = (c.to_pylist() for c in some.columns)
                rows = []
                for doc, packed in zip(ids, chunks.encode([t or "" for t in texts])):
                    packed += end
                    total = len(packed) // 4
                    for start in range(0, total, capacity):
                        own = packed[4 * start : 4 * (start + capacity)]
                        n = len(own) // 4
                        rows.append((doc, start, n, zlib.crc32(own), total, part, int(count[n]), own if n < capacity else None))
                        count[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- plan

class Packs:
    """Patterns by the length they reach: (number of packs, parts). A part is (length of the
    tails, first rank, ids before the part, ids in it); its ranks follow the packs."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: dict[int, list[tuple[int, tuple]]] = defaultdict(list)

    def shortest(self) -> int | None:
        return min((t for t, own in self.at.items() if own), default=None)

    def take(self, total: int, most: int) -> tuple[int, tuple]:
        """Up to ``most`` packs of one pattern; the rest of them stays."""
        n, parts = self.at[total].pop()
        if n > most:
            self.at[total].append((n - most, tuple((length, lo + most, cut, size) for length, lo, cut, size in parts)))
            n = most
        return n, parts

    def place(self, tails: tuple[int, int, int, int, int]) -> None:
        """``tails``: length, first rank, number, ids before, ids each."""
        length, lo, n, cut, size = tails
        while n:
            total = self.shortest()
            if total is None or total + size > self.capacity:
                self.at[size].append((n, ((length, lo, cut, size),)))
                return
            k, parts = self.take(total, n)
            self.at[total + size].append((k, (*parts, (length, lo, cut, size))))
            lo, n = lo + k, n - k


def padding(total: int, capacity: int) -> int:
    """Sequences are padded to the capacity, except at a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total


def _mend(packs: Packs, loose: int) -> Packs:
    """Packs whose gaps are filled with the tails of the shortest ones, and without those."""
    capacity, done, open_ = packs.capacity, Packs(packs.capacity), Packs(packs.capacity)
    for total, own in packs.at.items():
        (open_ if padding(total, capacity) >= loose else done).at[total] += own
    room, given = sum(n * (capacity - total) for total, own in open_.at.items() for n, _ in own), []
    while (total := open_.shortest()) is not None and (most := room // capacity):
        n, parts = open_.take(total, most)
        given.append((n, parts))
        room -= n * capacity
    todo = [(-size, length, lo, n, cut) for n, parts in given for length, lo, cut, size in parts]
    heapq.heapify(todo)
    while todo:
        size, length, lo, n, cut = heapq.heappop(todo)
        size, total = -size, open_.shortest()
        if total is None:
            done.place((length, lo, n, cut, size))
            continue
        part = min(size, capacity - total)
        k, parts = open_.take(total, n)
        now = total + part
        (open_ if padding(now, capacity) >= loose else done).at[now].append((k, (*parts, (length, lo, cut, part))))
        if part < size:
            heapq.heappush(todo, (part - size, length, lo, k, cut + part))
        if k < n:
            heapq.heappush(todo, (-size, length, lo + k, n - k, cut))
    for total, own in open_.at.items():
        if padding(total, capacity) * 8 < capacity:
            done.at[total] += own
        else:
            for n, parts in own:
                _halve(done, total, n, parts)
    return done


def _halve(done: Packs, total: int, n: int, parts: tuple) -> None:
    """A pack as sequences of powers of two, longest first."""
    bits = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    left, own = bits.pop(0), []
    for length, lo, cut, size in parts:
        while size:
            some = min(size, left)
            own.append((length, lo, cut, some))
            cut, size, left = cut + some, size - some, left - some
            if not left:
                done.at[sum(p[3] for p in own)].append((n, tuple(own)))
                left, own = bits.pop(0) if bits else 0, []


PLAN = "length bigint, lo bigint, hi bigint, cut bigint, size bigint, sequence bigint, offset bigint"


def shortest_first(counts: dict[int, int], capacity: int = CAPACITY, loose: int = LOOSE) -> list[tuple[int, ...]]:
    """Plan rows: tails of ``length`` with rank ``lo`` to ``hi`` have their ids from ``cut``,
    ``size`` of them, in sequences from ``sequence`` on, at ``offset``."""
    packs = Packs(capacity)
    for length in sorted(counts, reverse=True):
        packs.place((length, 0, counts[length], 0, length))
    packs = _mend(packs, loose)
    plan, sequence = [], 0
    for _, own in sorted(packs.at.items()):
        for n, parts in own:
            offset = 0
            for length, lo, cut, size in parts:
                plan.append((length, lo, lo + n, cut, size, sequence, offset))
                offset += size
            sequence += n
    return plan


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, loose: int = LOOSE) -> DataFrame:
    """One row per piece: id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity), "shortest-pieces")
    cells = written(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "shortest-cells")
    # a row per length, at most `capacity`, reaches the driver
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = shortest_first(counts, capacity, loose)
    plan = spark.createDataFrame(rows, PLAN)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local")).alias("d")
    # the plan is bounded by the lengths and by `loose`, whatever the corpus holds
    slot = (F.col("d.length") == F.col("p.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    crc = F.col("ids_crc32")
    if any(r[4] < r[0] for r in rows):  # else no ids are read again
        own = F.substring("ids", (F.lit(4) * F.col("cut") + 1).cast("int"), (F.lit(4) * F.col("size")).cast("int"))
        crc = F.when(F.col("size") == F.col("d.length"), crc).otherwise(F.crc32(own))
    return ranked.join(F.broadcast(plan.alias("p")), slot).select(
        F.col("doc").alias(id_col), (F.col("start") + F.col("cut")).alias("start"), F.col("size").alias("length"), crc.alias("ids_crc32"),
        "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )
