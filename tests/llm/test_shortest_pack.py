"""Shortest-pack-first packing: whole ids, gapless sequences, little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telemetra.llm import queries, shortest_pack
from telemetra.llm.common import table

from llm_fixtures import documents  # noqa: F401

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", "a \n b", "\n\nx", "x\n\n", "tab\tand\x0bmore", "don't we'll I'd", "x<|endoftext|>y  <|endoftext|> z", "ÀÉß²³Ⅷ ½ 1234 a1b2", "日本語 テキスト。 ok",
       "\U0001f600 emoji \U0001f468‍\U0001f469", "a b  c d", "\x1c\x1d sep\x85", "end. ", " start", "((a)) [b], {c}; `d` ~e", "'s 't ' ''", "word's, word.'s"]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_ids_are_the_tokenizers():
    own = shortest_pack.ChunkIds(queries.tokenizer("byte_bpe_50k.json"))
    rng = random.Random(2)
    alphabet = [*ODD, "word", "Word,", " ", "\n", "  ", "'", "don't", "12", "é", "\t", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(600)]
    for i in range(0, len(texts), 50):
        some = texts[i : i + 50]
        want = [e.ids for e in own.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(some)] == want


def test_ids_around_separators_and_wide_spaces():
    own = shortest_pack.ChunkIds(queries.tokenizer("byte_bpe_50k.json"))
    rng = random.Random(5)
    alphabet = ["a", "b ", "  ", "\n", " \n", "\t", ",", "'s", "'", "1", "é", "É,", "\u00a0", "\u2009", "\u2028", "\u3000", "\u0085", "日本", "\U0001f600",
                "<|endoftext|>", "-", "don't", "ſ", "²", "\x1c", "\x1f", "\u180e", "\u200b", "\u0301", "word", "Word."]
    texts = ["\u0085b \u0085\x1c\xe9", "\x1c\u200b,", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000))]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == want


def test_pieces_met_once_are_forgotten(monkeypatch):
    monkeypatch.setattr(shortest_pack, "CACHE_PIECES", 60)
    own = shortest_pack.ChunkIds(queries.tokenizer("byte_bpe_50k.json"))
    for i in range(40):
        text = "often met words, and\nonce: " + " ".join(f"x{j}" for j in range(7 * i, 7 * i + 7))
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 75
    assert b" met" in own.known and b" x0" not in own.known


def test_a_text_is_cut_and_looked_up_by_arrays():
    """Words met before take no step of Python each: what is looked up are the different pieces of a slice."""
    own, seen = shortest_pack.ChunkIds(queries.tokenizer("byte_bpe_50k.json")), []

    class Seen(dict):
        def __getitem__(self, piece):
            seen.append(piece)
            return super().__getitem__(piece)

    own.known = Seen(own.known)
    ids = own.encode(["some words, and some\nmore words " * 1000 + "end"])[0]
    assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode("some words, and some\nmore words " * 1000 + "end", add_special_tokens=False).ids
    assert 0 < len(seen) < 20


def test_slices_hold_every_row_once():
    texts = [None, "", "x" * shortest_pack.SLICE, "y", "z" * (2 * shortest_pack.SLICE), None, "é" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
    slices = list(shortest_pack._slices(batch))
    assert [x for s in slices for x in s.column(0).to_pylist()] == list(range(len(texts))) and len(slices) > 2
    assert list(shortest_pack._slices(batch.slice(0, 0))) == []


def test_another_tokenizer_is_used_whole():
    own = shortest_pack.ChunkIds(queries.tokenizer("word_bpe_49k.json"))
    assert not own.chunked
    assert np.frombuffer(own.encode(["Two  words"])[0], "<u4").tolist() == own.tokenizer.encode("Two  words", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["long", "half", "short", "one", "mixed", "wide"])
def test_plan_covers_every_tail_once(name):
    rng = random.Random(3)
    counts = {"long": {1024: 7, 900: 500, 700: 300}, "half": {513: 1001}, "short": {3: 100_000, 50: 7}, "one": {701: 1},
              "mixed": Counter(rng.randrange(1, 1025) for _ in range(20_000)), "wide": {600 + i: 10**9 + i for i in range(200)}}[name]
    plan = shortest_pack.shortest_first(counts)
    covered, packs = defaultdict(list), defaultdict(list)
    for length, lo, hi, cut, size, sequence, offset in plan:
        assert 0 <= cut and cut + size <= length and lo < hi
        covered[length].append((lo, hi, cut, size))
        packs[sequence, hi - lo].append((offset, size))
    for length, n in counts.items():
        assert sum((hi - lo) * size for lo, hi, _, size in covered[length]) == n * length
        marks = sorted({x for lo, hi, *_ in covered[length] for x in (lo, hi)})
        for lo in marks[:: max(1, len(marks) // 50)]:
            at = 0
            for cut, size in sorted((c, s) for a, b, c, s in covered[length] if a <= lo < b):
                assert cut == at
                at += size
            assert at == (length if lo < n else 0)
    padded = total = sequence = 0
    for (first, n), parts in sorted(packs.items()):
        assert first == sequence
        sequence, at = sequence + n, 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 1024
        padded, total = padded + n * shortest_pack.padding(at, 1024), total + n * at
    assert padded <= 0.016 * total
    assert len(plan) < 100_000


def check(docs, out, capacity=1024):
    """Pieces against the tokenizer's ids, for documents with distinct ids."""
    tokenizer = shortest_pack.ChunkIds(queries.tokenizer("byte_bpe_50k.json")).tokenizer
    by, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == {i for i, _ in docs}
    tokens = 0
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        tokens, at = tokens + len(ids), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padded += shortest_pack.padding(at, capacity)
    return padded, tokens


def test_packs_of_the_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    padded, tokens = check(docs, queries.op13_shortest_pack(spark, SMALL).collect())
    assert padded <= 0.01 * tokens


def test_cut_tails_have_the_right_ids(documents):  # noqa: F811
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "beta,", "gamma.", "don't"]) for _ in range(420 + rng.randrange(40)))) for i in range(300)]
    frame = documents(*docs).repartition(7)
    out = shortest_pack.pack(frame, queries.tokenizer("byte_bpe_50k.json")).collect()
    assert any(r["start"] % 1024 for r in out)
    padded, tokens = check(docs, out)
    assert padded <= 0.016 * tokens


def test_odd_rows(documents):  # noqa: F811
    path = queries.tokenizer("byte_bpe_50k.json")
    frame = documents((1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "same text"), (4, "word " * 30_000))
    for name in ("length", "part", "local", "rank", "cut", "size", "ids", "start"):
        frame = frame.withColumn(name, F.lit("more"))
    out = shortest_pack.pack(frame, path).collect()
    assert sum(r["length"] for r in out) == 2 + 3 * 3 + max(r["doc_tokens"] for r in out)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert shortest_pack.pack(frame.limit(0), path).count() == 0
