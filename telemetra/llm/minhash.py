"""Near-duplicate classes by DartMinHash signatures.

A text is the weighted set of its five-word shingles, each weighted by how often it occurs;
a pair is linked when the weighted Jaccard similarity is at least ``THRESHOLD``, and classes
are the connected components of the links.

Signatures: every unit of an element's weight owns a strip of the (weight, rank) plane.
Darts fall on it at places fixed by hashing (a Poisson number per dyadic rank region), each
with a coordinate of the signature; a text keeps, per coordinate, the dart of least rank
inside its own region. Two texts agree in a coordinate with a probability equal to their
weighted Jaccard similarity. Bands of ``ROWS`` coordinates meet in an equi-join.

Candidates: texts with equal words are one node. In a band bucket every member is compared
with the bucket's least node, never all with all. Buckets whose members are still in
different components then compare those outside the largest component with all others,
counting common shingles over postings, so that links come out and no pairs. Every
similarity is computed exactly on the whole texts.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^4)^24 = 3e-6.

Defined cases: a null text or one without words is alone in its class; one to four words
form a single shingle. Equal rows are in one class. Null ids are kept as they are. An empty
table gives an empty result; further columns pass through :func:`keep_one`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm.common import WORD, plainly_named, with_row_id, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
# Members of a bucket that are compared in one piece of work, and their shingles.
BLOCK, BLOCK_CELLS = 4000, 2_000_000
# Shingles whose counts a task keeps for texts that come again; postings looked at in one go.
RECENT_CELLS, POSTINGS = 400_000, 4_000_000

_WORD = re.compile(WORD)
_U = np.uint64
_STEPS = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


_cdf: dict[float, np.ndarray] = {}


def poisson_cdf(mean: float) -> np.ndarray:
    if mean not in _cdf:
        n = np.arange(int(mean + 12 * math.sqrt(mean) + 40))
        logs = n * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
        _cdf[mean] = np.cumsum(np.exp(logs))
    return _cdf[mean]


def signature(cells: np.ndarray, k: int) -> np.ndarray:
    """Dart of least rank per coordinate for a set of unit cells (64-bit names)."""
    reach = k * (math.log(k) + 2) / len(cells)
    while True:
        ids, ranks, low, width, region = [], [], 0.0, 1.0, 0
        while low < reach:
            names = mix(cells + _STEPS[region])
            n = np.searchsorted(poisson_cdf(width), unit(names), side="right")
            at = np.repeat(np.arange(len(cells)), n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(names[at] + (nth + 1).astype(np.uint64) * _M1)
            ids.append(dart)
            ranks.append(low + width * unit(mix(dart + _GOLD)))
            low, width, region = low + width, low + width, region + 1
        dart, rank = np.concatenate(ids), np.concatenate(ranks)
        inside = rank < reach
        dart, rank = dart[inside], rank[inside]
        order = np.argsort(-rank, kind="stable")
        out, hit = np.zeros(k, dtype=np.uint64), np.zeros(k, dtype=bool)
        place = (dart % _U(k)).astype(np.int64)[order]
        out[place], hit[place] = dart[order], True  # the last, of least rank, stays
        if hit.all():
            return out
        reach *= 2


def shingles(words: list[str]) -> Counter:
    """Five-word shingles and their counts; fewer words are one shingle."""
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[i:] for i in range(SHINGLE))))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two counted sets."""
    if len(b) < len(a):
        a, b = b, a
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


class Sketcher:
    """Key, size and band hashes of texts; keeps the hashes of words it has met."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def cells(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > 400_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - SHINGLE + 1)
        name = np.zeros(n, dtype=np.uint64)
        for i in range(min(SHINGLE, len(words))):
            name = mix(name + _GOLD) ^ h[i : i + n]
        name = np.sort(mix(name))
        new = np.concatenate([[True], name[1:] != name[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        return mix(name + (np.arange(n) - start).astype(np.uint64) * _M2)

    def bands(self, text: str | None) -> tuple[str | None, int, list[int] | None]:
        words = _WORD.findall(text or "")
        if not words:
            return None, 0, None
        sig = signature(self.cells(words), BANDS * ROWS).reshape(BANDS, ROWS)
        h = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
        for i in range(ROWS):
            h = mix(h ^ sig[:, i])
        key = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()
        return key, max(1, len(words) - SHINGLE + 1), h.view(np.int64).tolist()


SKETCH = "_key string, _size bigint, _bands array<bigint>"


def sketched(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_row`` and the sketch columns, written once."""
    rows = with_row_id(docs)
    at = rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(SKETCH).fields])
    made = rows.mapInArrow(_sketch_batches(at, schema.names), schema)
    return written(made, "minhash-sketch")


def _sketch_batches(at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in batches:
            found = [sketcher.bands(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
                   pa.array([f[2] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b`` of the pairs whose whole texts are similar enough.

    ``texts``: ``node, text``. The second join leaves the rows sorted by ``b``, so a task
    counts the shingles of a bucket's pivot once."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, Counter] = OrderedDict()
        held = 0

        def counted(node: int, text: str) -> Counter:
            nonlocal held
            if node not in recent:
                found = shingles(_WORD.findall(text or ""))
                held += len(found)
                while recent and held > RECENT_CELLS:
                    held -= len(recent.popitem(last=False)[1])
                recent[node] = found
            recent.move_to_end(node)
            return recent[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [i for i in range(len(a)) if similarity(counted(b[i], batch.column(3)[i].as_py()), counted(a[i], batch.column(2)[i].as_py())) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node of each component, for nodes with links.

    Each round takes the least label among the neighbours, then the label's own label;
    every round is written, so lineage does not grow."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = now.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(least.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label")), "labels")
        moved = new.where("label != was").limit(1).count()
        now = new.select("node", "label")
        if not moved:
            return now


def classes(sketch: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``_row, label`` for every row of :func:`sketched`; the label is the least row of the
    class."""
    named = sketch.select("_row", "_key", "_size")
    nodes = written(named.where("_key is not null").groupBy("_key").agg(F.min("_row").alias("node"), F.first("_size").alias("size")), "minhash-nodes")
    own = sketch.join(nodes.select(F.col("node").alias("_row"), "size"), "_row")
    bands = own.select(F.col("_row").alias("node"), "size", F.explode("_bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("pivot")).where("n > 1")
    members = written(bands.join(shared, "bucket").select("bucket", "node", "size", "pivot"), "minhash-buckets")
    texts = sketch.select(F.col("_row").alias("node"), F.col(text_col).alias("text"))
    near = lambda x, y: F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)  # noqa: E731  sizes that allow the similarity

    first = members.where((F.col("node") != F.col("pivot.node")) & near(F.col("size"), F.col("pivot.size")))
    pairs = first.select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct()
    met = written(members.select("node").distinct(), "minhash-met")
    labels = _joined(met, components(written(verified(pairs, texts, threshold), "minhash-links")))
    rest = written(_linked_in_buckets(_split_buckets(members, labels), texts, threshold, block), "minhash-links")
    labels = _relabelled(labels, rest)
    by_key = nodes.join(labels, "node", "left").select("_key", F.coalesce("label", "node").alias("label"))
    return named.join(by_key, "_key", "left").select("_row", F.coalesce("label", "_row").alias("label"))


def _split_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their label, the bucket's
    largest component (``main``), and how many members and shingles it has, and how many of
    them outside that.

    Of two members one is the pivot, so those pairs are compared already."""
    labelled = members.select("bucket", "node", "size").join(labels, "node")
    parts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("cells"))
    split = parts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("cells").alias("cells"), F.max(F.struct("n", "label", "cells")).alias("most")).where("n > 2 and most.n < n")
    return labelled.drop("size").join(split.select(
        "bucket", F.col("most.label").alias("main"), "n", "cells", (F.col("n") - F.col("most.n")).alias("outside"), (F.col("cells") - F.col("most.cells")).alias("outside_cells")), "bucket")


def _linked_in_buckets(split: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links ``a, b`` between components: each member outside a bucket's largest component
    against all other members, counted over postings, one link per component kept.

    A bucket is one piece of work up to ``block`` members and ``BLOCK_CELLS`` shingles; a
    larger one is cut into blocks of members and blocks of those outside, every pair of blocks
    a piece of its own. A piece holds eight bytes a shingle of its members (their 64-bit
    names); those outside pass by them one at a time, and every link found is checked on the
    whole texts."""
    blocks = lambda n, cells: F.ceil(F.greatest(F.col(n) / block, F.col(cells) / BLOCK_CELLS)).cast("int")
    members, others = blocks("n", "cells"), blocks("outside", "outside_cells")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    place = lambda o, m, role: F.struct(o.alias("o"), m.alias("m"), F.lit(role).alias("role"))
    outside = F.col("label") != F.col("main")
    single = F.array(place(F.lit(0), F.lit(0), 3))
    several = F.concat(
        F.transform(F.sequence(F.lit(0), others - 1), lambda o: place(o, own(members), 1)),
        F.when(outside, F.transform(F.sequence(F.lit(0), members - 1), lambda m: place(own(others), m, 2))).otherwise(F.array().cast("array<struct<o:int,m:int,role:int>>")),
    )
    rows = split.withColumn("at", F.explode(F.when(members <= 1, single).otherwise(several)))
    rows = rows.select("bucket", "at.o", "at.m", "node", "label", F.when(F.col("at.role") == 3, F.when(outside, 3).otherwise(1)).otherwise(F.col("at.role")).alias("role"))
    whole = rows.join(texts, "node").select("bucket", "o", "m", "node", "label", "role", "text")
    # members first, then those that are only compared with them
    dealt = whole.repartition("bucket", "o", "m").sortWithinPartitions("bucket", "o", "m", F.col("role") == 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, piece, at = Sketcher(), Piece(threshold), None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                *key, node, label, role, text = (c[i].as_py() for c in batch.columns)
                if key != at:
                    found += piece.inner()
                    piece, at = Piece(threshold), key
                words = _WORD.findall(text or "")
                if not words:
                    continue
                cells = sketcher.cells(words)
                if role & 1:
                    piece.add(node, label, cells, role == 3)
                else:
                    found += piece.links(node, label, cells)
            yield _pairs(found)
        yield _pairs(piece.inner())

    links = dealt.mapInArrow(run, "a bigint, b bigint")
    return verified(written(links.distinct(), "minhash-near"), texts, threshold)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


class Piece:
    """Postings of the members of one piece of work."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.nodes, self.labels, self.cells, self.outside = [], [], [], []
        self.sorted = None

    def add(self, node: int, label: int, cells: np.ndarray, outside: bool) -> None:
        if outside:
            self.outside.append(len(self.nodes))
        self.nodes.append(node)
        self.labels.append(label)
        self.cells.append(cells)

    def _index(self) -> None:
        self.size = np.array([len(c) for c in self.cells])
        self.label = np.array(self.labels)
        cell = np.concatenate(self.cells)
        order = np.argsort(cell, kind="stable")
        self.sorted = cell[order]
        self.holder = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[order]

    def links(self, node: int, label: int, cells: np.ndarray) -> list[tuple[int, int]]:
        """One link to every component but the own that has a member near enough."""
        if not self.nodes:
            return []
        if self.sorted is None:
            self._index()
        start, end = np.searchsorted(self.sorted, cells, "left"), np.searchsorted(self.sorted, cells, "right")
        both, hits = np.zeros(len(self.nodes), dtype=np.int64), np.cumsum(end - start)
        at, done = 0, 0
        while at < len(cells):
            to = max(at + 1, int(np.searchsorted(hits, done + POSTINGS, "right")))
            n = (end - start)[at:to]
            place = np.repeat(start[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both += np.bincount(self.holder[place], minlength=len(both))
            at, done = to, int(hits[to - 1])
        near = np.flatnonzero((self.label != label) & (both >= self.threshold * (len(cells) + self.size - both)))
        return [(node, self.nodes[near[k]]) for k in np.unique(self.label[near], return_index=True)[1]]

    def inner(self) -> list[tuple[int, int]]:
        """Links of the members that stand outside the largest component."""
        return [link for i in self.outside for link in self.links(self.nodes[i], self.labels[i], self.cells[i])]


def _joined(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label`` for every node that shares a bucket, its own label without links."""
    return written(met.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after new links: components of the labels that the links join."""
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    merged = found.join(a, "a").join(b, "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    into = components(merged).select(F.col("node").alias("label"), F.col("label").alias("into"))
    return written(labels.join(into, "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``class_id`` (least id of its class) and ``class_size``."""
    sketch = sketched(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")))
    labelled = written(classes(sketch).join(sketch.select("_row", "_id"), "_row"), "minhash-classes")
    named = labelled.groupBy("label").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return labelled.join(named, "label").select(F.col("_id").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Pipeline form: the first row of every class, all columns."""
    plain, text = plainly_named(docs), f"c{docs.columns.index(text_col)}"
    sketch = sketched(plain, text)
    kept = classes(sketch, text_col=text).where("_row = label").select("_row")
    return sketch.join(kept, "_row", "left_semi").select(plain.columns).toDF(*docs.columns)
