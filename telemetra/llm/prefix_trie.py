"""Conversation prefix trie by adaptive radix trees.

A turn's id is 20 bytes, big-endian: 16 of the SHA-256 of its role and text, 4 with the
text's code points. A conversation's key is the ids of its turns in a row. Keys are dealt out
by range, so that a prefix that a third of all conversations share spreads over tasks; each
task puts its range into one radix tree, whose nodes hold compressed paths and grow through
layouts of 4, 16, 48 and 256 children. Byte depths that are whole turns are the trie's nodes.

A node whose keys reach over the end of a range is met by several tasks. Its figures are
sums, written so that they add up: each task adds the members it has, and the task with the
node's first key adds what counts once per node. How many turns two neighbouring ranges
share is known from their first and last keys, so only these nodes are aggregated again.

Defined cases: rows without a conversation id belong to none; a null role or text is empty;
rows of one turn are ordered by their ids; an empty table has no root and gives an empty
result; further columns are not read. A conversation's key (20 bytes a turn) is held by one
task at a time, its text by none.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm.common import written

WIDTH = 20
# Bytes of keys (and 64 a conversation) in one radix tree.
TREE_BYTES = 2 << 20
NO_ENDS = hashlib.sha256().hexdigest()


# ---------------------------------------------------------------- radix tree

class Few:
    """Up to 4 or 16 children, their bytes sorted beside them."""

    def __init__(self, size: int = 4):
        self.size, self.bytes, self.kids = size, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, kid):
        """The layout that holds the child, which is the next larger one if this is full."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.size:
            grown = Few(16) if self.size == 4 else Indexed()
            for b, k in self.items():
                grown.put(b, k)
            return grown.put(byte, kid)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self):
        return zip(self.bytes, self.kids)


class Indexed:
    """Up to 48 children, found through an index of all bytes."""

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def get(self, byte: int):
        slot = self.index[byte]
        return self.kids[slot - 1] if slot else None

    def put(self, byte: int, kid):
        slot = self.index[byte]
        if slot:
            self.kids[slot - 1] = kid
            return self
        if len(self.kids) == 48:
            grown = Direct()
            for b, k in self.items():
                grown.put(b, k)
            return grown.put(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def items(self):
        return ((b, self.kids[slot - 1]) for b, slot in enumerate(self.index) if slot)


class Direct:
    """A place for every byte."""

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def items(self):
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    """``path``: the bytes that all keys below share; ``own``: what ends here."""

    __slots__ = ("path", "kids", "own")

    def __init__(self, path: bytes, own=None):
        self.path, self.kids, self.own = path, Few(), own


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, own) -> None:
        if self.root is None:
            self.root = Node(key, own)
            return
        node, at, up = self.root, 0, None
        while True:
            same = _shared(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                fork = Node(node.path[:same])
                fork.kids.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if up is None:
                    self.root = fork
                else:
                    up.kids.put(key[at - 1], fork)
                node = fork
            at += same
            if at == len(key):
                node.own = own
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids = node.kids.put(key[at], Node(key[at + 1 :], own))
                return
            up, node, at = node, kid, at + 1


# ---------------------------------------------------------------- one range of keys

class _Sum:
    """Figures of the keys below a radix node; ``tops`` are its highest trie nodes."""

    __slots__ = ("key", "n", "low", "leaves", "saved", "tops")

    def __init__(self):
        self.key, self.n, self.low, self.leaves, self.saved, self.tops = b"", 0, None, 0, 0, []


# of an emitted row
CONV, DEPTH, PARENT_CONV, NODE, PARENT = 0, 1, 2, 8, 9


def _digest(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()[:16]


def emit(tree: RadixTree, first: bytes, last: bytes, before: int, after: int) -> list[list]:
    """Rows of the trie's nodes in this range: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends, node, parent``; the last two only for nodes that
    reach into another range and for their children. ``before`` and ``after``: turns that the
    first and the last key share with the neighbouring ranges, -1 for none."""
    rows: list[list] = []

    def close(node: Node, start: int, end: int, below: list[_Sum]) -> _Sum:
        here = _Sum()
        for s in below:
            here.key, here.n, here.leaves, here.saved = s.key, here.n + s.n, here.leaves + s.leaves, here.saved + s.saved
            here.low = s.low if here.low is None else min(here.low, s.low)
            here.tops += s.tops
        if node.own:
            key, n, low, _ = node.own
            here.key, here.n, here.low = key, here.n + n, low if here.low is None else min(here.low, low)
        key = here.key
        for depth in range(end // WIDTH, -(-start // WIDTH) - 1, -1):
            at = depth * WIDTH
            continued = depth <= before and key[:at] == first[:at]
            reaches = continued or depth <= after and key[:at] == last[:at]
            length = int.from_bytes(key[at - 4 : at], "big") if depth else 0
            here.saved += length * (here.n - (not continued))
            ends = node.own[3] if node.own and at == end else None
            if not (here.tops or reaches):  # one that reaches on has its children there
                here.leaves = 1
            name = _digest(key[:at]) if reaches else None
            # a child that another range has begun is counted there
            children = sum(not t[1] for t in here.tops)
            for row, _ in here.tops:
                if reaches:
                    row[PARENT] = name
                else:
                    row[PARENT_CONV] = here.low
            row = [here.low, depth, None, here.n, children, here.leaves, here.saved, ends, name, None]
            rows.append(row)
            here.tops = [(row, continued)]
        return here

    # depth first without recursion: a key may have any number of turns
    done: list[list[_Sum]] = [[]]
    todo: list[tuple] = [(tree.root, 0, False)]
    while todo:
        node, start, ready = todo.pop()
        end = start + len(node.path)
        if not ready:
            todo.append((node, start, True))
            done.append([])
            todo += [(kid, end + 1, False) for _, kid in node.kids.items()]
        else:
            below = done.pop()
            done[-1].append(close(node, start, end, below))
    return rows


# ---------------------------------------------------------------- Spark

def turn_ids(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``conv, turn, id`` of every row that has a conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    digest = F.substring(F.sha2(whole, 256), 1, 2 * (WIDTH - 4))
    return rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text("text"))), 8, "0"))).alias("id"),
    )


def _key(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(F.array_sort(turns), lambda t: F.hex(t["id"])), ""))


def keys(ids: DataFrame) -> DataFrame:
    """``conv, key``: the conversations as they are."""
    return ids.repartition("conv").groupBy("conv").agg(_key(F.collect_list(F.struct("turn", "id"))).alias("key"))


def rebuilt_keys(ids: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """``conv, key``: the first h turns of the block's first conversation, then the own turns
    after the first h; h is the CRC-32 of the id modulo ``most``. One shuffle, by block."""
    base = F.col("conv") - F.col("conv") % block
    own = ids.withColumn("base", base).repartition("base").groupBy("base", "conv").agg(_key(F.collect_list(F.struct("turn", "id"))).alias("own"))
    head = F.max(F.when(F.col("conv") == F.col("base"), F.substring("own", 1, (most - 1) * WIDTH))).over(Window.partitionBy("base"))
    taken = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % most * WIDTH).cast("int")
    empty = F.lit(b"")
    return own.withColumn("head", F.coalesce(head, empty)).withColumn("taken", taken).select(
        "conv", F.concat(F.substring("head", F.lit(1), F.col("taken")), F.substring("own", F.col("taken") + 1, F.length("own"))).alias("key"))


ROW = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
       "ends string, node binary, parent binary")
_SCHEMA = pa.schema([*[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
                     ("ends", pa.string()), ("node", pa.binary()), ("parent", pa.binary())])


def _overlaps(bounds: DataFrame) -> DataFrame:
    """Per range: turns that its first key shares with the range before, its last key with
    the one after. A row per range passes here."""
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("after", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns(a, b):
            return -1 if a is None or b is None else _shared(a, b) // WIDTH

        for batch in batches:
            out = [(part, turns(prev, first), turns(last, following)) for part, first, last, prev, following in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    order = Window.orderBy("part")
    near = bounds.select("part", "first", "last", F.lag("last").over(order).alias("prev"), F.lead("first").over(order).alias("following"))
    return near.mapInArrow(run, "part int, before bigint, after bigint")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conv, key``."""
    spark = conversations.sparkSession
    all_keys = written(conversations, "trie-keys")
    size = all_keys.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TREE_BYTES))
    ranged = written(all_keys.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "trie-ranges")
    overlaps = _overlaps(ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")))
    sorted_keys = ranged.join(overlaps, "part").repartition(n, "part").sortWithinPartitions("part", "key", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key = tree = first = None
        own = ()  # conversations of the key at hand: number, least, hash of the ids

        def put():
            count, least, ids = own
            tree.insert(key, (key, count, least, ids.hexdigest()))

        def finish() -> Iterator[pa.RecordBatch]:
            put()
            rows = emit(tree, first, key, *near)
            for at in range(0, len(rows), 10_000):
                some = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some), _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for p, k, conv, before, after in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    if p != part:
                        if part is not None:
                            yield from finish()
                        part, tree, first, near, key = p, RadixTree(), k, (before, after), None
                    if k != key:
                        if key is not None:
                            put()
                        key, own = k, (1, conv, hashlib.sha256(str(conv).encode()))
                    else:
                        own[2].update(b",%d" % conv)
                        own = own[0] + 1, own[1], own[2]
        if part is not None:
            yield from finish()

    found = written(sorted_keys.select("part", "key", "conv", "before", "after").mapInArrow(run, ROW), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    split = written(found.where("node IS NOT NULL").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends").alias("ends"), F.max("parent").alias("parent")), "trie-split")
    whole = found.where("node IS NULL").unionByName(split.withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    above = split.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    return whole.join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
