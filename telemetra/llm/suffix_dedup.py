"""Repeated byte strings and word passages by winnowing with window hashes, in place of prefix doubling.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else in the corpus
is removed. Passages of ``WORDS`` words that also stand in another document are counted, not
removed: most of them are shorter than ``LENGTH`` bytes. Positions are ranked by 64-bit names
(hashes), first of short stretches and then of whole windows, and drop out once their name is
unique; there is no global sort.

1. In each text the names of ``HALF`` bytes are built for all positions. A window of
   ``LENGTH`` bytes is represented by the position of the least name inside it; equal
   windows have equal representatives, and about one position in a hundred represents any.
   The run of windows that share a representative is a *zone*. Windows of ``WORDS`` words have
   zones likewise, by names of ``GRAM`` words. A name's last bit tells words from bytes.
2. Spark counts the representatives' names: unique ones drop out with all their windows. Of
   the others (name, zone name) pairs are grouped: zones that occur twice (of words: in two
   documents) are past the threshold.
3. Zones that meet an equal name in a different zone go on, one of each kind (of words: all
   that are not past the threshold): Spark deals and sorts them by name, and within a name the
   windows are named again at full length. Names with more than ``GROUP`` of them are ranked
   window by window in a distributed aggregation instead.
4. The covered runs of each text are joined; those of bytes are cut out.

Texts are UTF-8 bytes; words are runs without ASCII white space; matches never cross documents.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes keep all bytes; equal
rows cover each other, and each is a document; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import with_row_id, written

LENGTH, HALF = 400, 200
WORDS, GRAM = 50, 20
GROUP = 20_000
# Windows of a text that are worked on at a time, and the bits that number them.
CHUNK, BITS = 1 << 20, 21
BUFFER = 4_000_000
SPACES = b" \t\n\v\f\r"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random number per byte, and powers of an odd base with their inverses."""
    base = 0x5851F42D4C957F2D
    n = CHUNK + LENGTH + 1
    up = np.full(n, base, dtype=np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64), np.cumprod(up), np.cumprod(down)


def sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which the name of any stretch of symbols (64-bit numbers) follows."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * _tables()[1][: len(symbols)], out=out[1:])
    return out


def names(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the stretches from ``start`` to ``end``, wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _tables()[2][start])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = np.minimum(x[: -(width - size)], x[width - size :])
    return x


def _zones(symbols: np.ndarray, length: int, half: int) -> tuple[np.ndarray, ...]:
    """(name of the representative, name of the zone, first symbol, end) of each zone."""
    prefix = sums(symbols)
    n = len(symbols) - half + 1
    name = mix((prefix[half:] - prefix[:n]) * _tables()[2][:n])
    place = np.arange(n, dtype=np.uint64)
    # equal names inside a window: the first, so that it depends on the window alone
    key = (name >> np.uint64(BITS) << np.uint64(BITS)) | place
    at = (least(key, length - half + 1) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.concatenate([first[1:], [len(at)]]) - 1 + length
    return name[at[first]], names(prefix, first, end) ^ mix((end - first).astype(np.uint64)), first, end


def byte_zones(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(name of the representative, name of the zone, begin, end) of the zones of byte windows."""
    last = len(text) - LENGTH
    for begin in range(0, last + 1, CHUNK):
        stop = min(begin + CHUNK, last + 1)  # windows begin..stop-1
        data = np.frombuffer(text, dtype=np.uint8, count=stop - begin + LENGTH - 1, offset=begin)
        name, zone, first, end = _zones(_tables()[0][data], LENGTH, HALF)
        yield name & ~np.uint64(1), zone, first + begin, end + begin


@functools.cache
def _solid() -> np.ndarray:
    return ~np.isin(np.arange(256), list(SPACES))


def words(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, begin, end) of the words, at most ``CHUNK`` bytes at a time; a word as long as
    that comes alone."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at >= CHUNK:
            stop = max(text.rfind(SPACES[i : i + 1], at, at + CHUNK) for i in range(len(SPACES)))
            if stop < 0:
                space = re.compile(b"[" + SPACES + b"]").search(text, at + CHUNK)
                stop = space.start() if space else len(text)
                name = int.from_bytes(hashlib.blake2b(text[at:stop], digest_size=8).digest(), "little")
                yield np.array([name], np.uint64), np.array([at]), np.array([stop])
                at = stop + 1
                continue
        data = np.frombuffer(text, dtype=np.uint8, count=stop - at, offset=at)
        solid = np.concatenate([[False], _solid()[data], [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        begin, end = edge[::2], edge[1::2]
        yield names(sums(_tables()[0][data]), begin, end), begin + at, end + at
        at = stop + 1


def word_zones(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """The same as :func:`byte_zones` for windows of words."""
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in words(text):
        held = tuple(np.concatenate(x) for x in zip(held, part))
        if len(held[0]) >= WORDS:
            name, zone, first, end = _zones(held[0], WORDS, GRAM)
            yield name | np.uint64(1), zone, held[1][first], held[2][end - 1]
            held = tuple(x[len(x) - WORDS + 1 :] for x in held)


def zones(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name of the representative, name of the zone, begin, end) of all zones of a text."""
    found = [*byte_zones(text), *word_zones(text)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


TEXTS = "_id {id}, _row bigint, n_bytes bigint, sha string, packed binary, names array<bigint>, zones array<bigint>, begins array<int>, ends array<int>"


def sampled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts (packed) with their zones, written once."""
    rows = with_row_id(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))).select("_id", "_row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
                name, zone, begin, end = zip(*map(zones, texts))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(map(len, texts), pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(map(pack.compress, texts), pa.binary()),
                    _column([x.view(np.int64) for x in name], pa.int64()), _column([x.view(np.int64) for x in zone], pa.int64()),
                    _column([x.astype(np.int32) for x in begin], pa.int32()), _column([x.astype(np.int32) for x in end], pa.int32()),
                ], names=["_id", "_row", "n_bytes", "sha", "packed", "names", "zones", "begins", "ends"])

    return written(rows.mapInArrow(run, TEXTS.format(id=rows.schema["_id"].dataType.simpleString())), "suffix-texts")


STRETCHES = {"name": pa.int64(), "settled": pa.bool_(), "least_row": pa.int64(), "last_row": pa.int64(), "_row": pa.int64(), "begin": pa.int32(), "bytes": pa.binary()}


def _stretches(active: DataFrame, column: str) -> DataFrame:
    """The bytes of the listed zones, with the first and last text in which each zone stands;
    ``settled`` ones are covered already and serve as partners only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, size = [], 0
            for row, packed, listed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = unpack.decompress(packed)
                for z in listed:
                    rows.append((z["name"], z["settled"], z["least_row"], z["last_row"], row, z["begin"], text[z["begin"] : z["end"]]))
                    size += z["end"] - z["begin"]
                if size > BUFFER:
                    yield _batch(rows, STRETCHES)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, STRETCHES)

    listed = active.where(F.size(column) > 0).select("_row", "packed", column)
    return listed.mapInArrow(run, "name bigint, settled boolean, least_row bigint, last_row bigint, _row bigint, begin int, bytes binary")


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def windows(parts: list[bytes], by_word: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, stretch, begin, end) of all windows of all stretches, places counted in the stretch."""
    out, at, length = [], 0, WORDS if by_word else LENGTH
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) < CHUNK):
            size += len(parts[end]) + 1
            end += 1
        sizes = np.array([len(p) + by_word for p in parts[at:end]], dtype=np.int64)
        head = np.cumsum(sizes) - sizes
        if by_word:
            symbols, begin, stop = (np.concatenate(x) for x in zip(*words(b"\n".join(parts[at:end]))))
            sizes = np.bincount(np.searchsorted(head, begin, "right") - 1, minlength=len(sizes))
        else:
            symbols = _tables()[0][np.frombuffer(b"".join(parts[at:end]), dtype=np.uint8)]
            begin = np.arange(len(symbols))
            stop = begin + 1
        count = sizes - length + 1
        owner = np.repeat(np.arange(len(count)), count)
        first = np.arange(len(owner)) + ((np.cumsum(sizes) - sizes) - (np.cumsum(count) - count))[owner]
        out.append((names(sums(symbols), first, first + length), owner + at, begin[first] - head[owner], stop[first + length - 1] - head[owner]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out))


COVERED = "_row bigint, begin int, end int, words boolean"


def _runs(repeated: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: np.ndarray, begins: np.ndarray, by_word: bool) -> pa.RecordBatch:
    """Covered stretches of marked windows, a run each."""
    at = np.flatnonzero(repeated)
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])) if len(at) else at
    tail = np.concatenate([head[1:], [len(at)]]) - 1 if len(head) else head
    own = owner[at[head]]
    return pa.RecordBatch.from_arrays([
        pa.array(rows[own], pa.int64()), pa.array((begins[own] + begin[at[head]]).astype(np.int32)),
        pa.array((begins[own] + end[at[tail]]).astype(np.int32)), pa.array(np.full(len(own), by_word))], names=["_row", "begin", "end", "words"])


def ranked_by_name(stretches: DataFrame) -> DataFrame:
    """Covered stretches among zones of the same name: dealt and sorted by name, so that a
    task compares whole names with bounded memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def compared() -> Iterator[pa.RecordBatch]:
            for by_word in (False, True):
                listed = [h for h in held if h[0] & 1 == by_word]
                if not listed:
                    continue
                _, settled, least_row, last_row, rows, begins, parts = (list(c) for c in zip(*listed))
                name, owner, begin, end = windows(parts, by_word)
                _, inverse, times = np.unique(name, return_inverse=True, return_counts=True)
                if by_word:  # in two texts, whatever the zones
                    low, high = np.full(len(times), np.iinfo(np.int64).max), np.full(len(times), -1)
                    np.minimum.at(low, inverse, np.array(least_row)[owner])
                    np.maximum.at(high, inverse, np.array(last_row)[owner])
                    again = low < high
                else:
                    again = times > 1
                yield _runs(again[inverse] & ~np.array(settled)[owner], owner, begin, end, np.array(rows), np.array(begins), by_word)

        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BUFFER and item[0] != held[-1][0]:
                    yield from compared()
                    held, size = [], 0
                held.append(item)
                size += len(item[-1])
        yield from compared()

    return stretches.repartition("name").sortWithinPartitions("name").mapInArrow(run, COVERED)


def ranked_by_window(stretches: DataFrame) -> DataFrame:
    """The same for names with very many zones: each window is a row of an aggregation."""
    kinds = {"window": pa.int64(), "words": pa.bool_(), "settled": pa.bool_(), "least_row": pa.int64(), "last_row": pa.int64(), "_row": pa.int64(), "begin": pa.int32(), "end": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for by_word in (False, True):
                every = [r for r in rows if r[0] & 1 == by_word]
                for at in range(0, len(every), 2000):
                    _, settled, least_row, last_row, row, begins, parts = (list(c) for c in zip(*every[at : at + 2000]))
                    name, owner, begin, end = windows(parts, by_word)
                    place = np.array(begins)[owner]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((
                        name.view(np.int64), np.full(len(name), by_word), *(np.array(x)[owner] for x in (settled, least_row, last_row, row)), place + begin, place + end), kinds.values())], names=list(kinds))

    every = written(stretches.mapInArrow(run, "window bigint, words boolean, settled boolean, least_row bigint, last_row bigint, _row bigint, begin int, end int"), "suffix-windows")
    again = every.groupBy("words", "window").agg(F.count(F.lit(1)).alias("n"), F.min("least_row").alias("low"), F.max("last_row").alias("high"))
    again = again.where(F.when(F.col("words"), F.col("low") < F.col("high")).otherwise(F.col("n") > 1)).select("words", "window")
    return every.where("NOT settled").join(again, ["words", "window"], "left_semi").select("_row", "begin", "end", "words")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document: id, ``n_bytes, n_removed, n_spans, kept_sha256``, ``has_repeat``
    (something was removed), ``longest_repeat`` (bytes of the longest removed run),
    ``shares_passage`` (``WORDS`` words in a row also stand in another document),
    ``passage_words`` (words in such passages) and ``kept`` (the remaining bytes; null where
    nothing was removed)."""
    texts = sampled(docs, id_col, text_col)
    marks = texts.where(F.size("names") > 0).select("_row", F.explode(F.arrays_zip(
        F.col("names").alias("name"), F.col("zones").alias("zone"), F.col("begins").alias("begin"), F.col("ends").alias("end"))).alias("m"))
    marks = marks.select("_row", "m.*")
    twice = marks.groupBy("name").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("name")
    # written first: joins of written tables split a very common name over tasks
    marks = written(marks.join(written(twice, "suffix-names"), "name", "left_semi"), "suffix-marks")
    by_word = F.col("name").bitwiseAND(F.lit(1)) == 1
    kinds = marks.groupBy("name", "zone").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("_row", "begin")).alias("one"), F.min("_row").alias("least_row"), F.max("_row").alias("last_row"))
    # zones that stand twice (of words: in two texts) are covered
    kinds = written(kinds.withColumn("settled", F.when(by_word, F.col("least_row") < F.col("last_row")).otherwise(F.col("times") > 1)), "suffix-kinds")
    listed = F.when(by_word & ~F.col("settled"), F.col("times")).otherwise(1)
    several = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.sum(listed).alias("places"))
    # zones beside others of their name are to be ranked; one of each kind, where all share its fate
    ranked = written(kinds.join(several, "name").where("settled OR kinds > 1"), "suffix-several")
    kept = marks.join(ranked, ["name", "zone"]).withColumn(
        "listed", (F.col("kinds") > 1) & ((by_word & ~F.col("settled")) | (F.struct("_row", "begin") == F.col("one"))))
    kept = written(kept.where("settled OR listed").drop("zone", "times", "one"), "suffix-zones")
    covered = kept.where("settled").select("_row", "begin", "end", by_word.alias("words"))
    zone = F.struct("name", "settled", "least_row", "last_row", "begin", "end", ((F.col("kinds") > 1) & (F.col("places") > group)).alias("big"))
    rows = kept.groupBy("_row").agg(F.collect_list(F.when(F.col("listed"), zone)).alias("listed"))  # a text's own zones
    active = written(texts.select("_row", "packed").join(rows, "_row"), "suffix-active")
    pick = lambda big: F.filter("listed", lambda z: z["big"] == F.lit(big))
    found = written(ranked_by_name(_stretches(active.withColumn("picked", pick(False)), "picked")), "suffix-ranked")
    if ranked.where((F.col("kinds") > 1) & (F.col("places") > group)).limit(1).count():
        found = found.unionByName(ranked_by_window(_stretches(active.withColumn("picked", pick(True)), "picked")))
    runs = covered.unionByName(found).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "words"))).alias("runs"))
    cut = active.select("_row", "packed").join(runs, "_row").mapInArrow(
        _cut, "_row bigint, n_removed bigint, n_spans bigint, longest bigint, passage_words bigint, kept_sha256 string, kept binary")
    count = lambda column: F.coalesce(column, F.lit(0)).cast("bigint")
    return texts.select("_row", "_id", "n_bytes", "sha").join(cut, "_row", "left").select(
        F.col("_id").alias(id_col), "n_bytes", count("n_removed").alias("n_removed"), count("n_spans").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), (count("n_removed") > 0).alias("has_repeat"), count("longest").alias("longest_repeat"),
        (count("passage_words") > 0).alias("shares_passage"), count("passage_words").alias("passage_words"), "kept")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join each text's covered stretches, cut out those of bytes and count words in the others."""
    unpack = zstandard.ZstdDecompressor()
    kinds = {"_row": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "longest": pa.int64(), "passage_words": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    for batch in batches:
        out = []
        for row, packed, runs in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpack.decompress(packed)
            spans, passages = (_joined([r for r in runs if r["words"] == by_word]) for by_word in (False, True))
            ends = [0, *(end for _, end in spans)]
            rest = b"".join(text[a:b] for a, b in zip(ends, [*(begin for begin, _ in spans), len(text)]))
            out.append((row, len(text) - len(rest), len(spans), max((end - begin for begin, end in spans), default=0),
                        sum(len(text[begin:end].split()) for begin, end in passages), hashlib.sha256(rest).hexdigest(), rest if spans else None))
        if out:
            yield _batch(out, kinds)


def _joined(runs: list[dict]) -> list[tuple[int, int]]:
    """Sorted runs, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for run in runs:
        if out and run["begin"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], run["end"]))
        else:
            out.append((run["begin"], run["end"]))
    return out
