"""Pieces, gates and depths that bound work must not change results."""

import random

import numpy as np
import pytest

from llm_fixtures import documents  # noqa: F401
from telemetra.llm import decontaminate, suffix_dedup, url_filter


@pytest.mark.parametrize("piece", [32, 64, 1 << 15])
def test_passages_do_not_depend_on_the_piece(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rng = np.random.default_rng(2)
    texts = [rng.integers(-1, 9, n).astype(np.int32) for n in (0, 5, 32, 33, 0, 0, 500, 64, 1, 96, 0)]
    for column, kept in ((decontaminate._lists(texts), texts), (decontaminate._lists(texts).slice(3, 6), texts[3:9]), (decontaminate._lists([]), [])):
        want = [x[i : i + decontaminate.PASSAGE].tolist() for x in kept for i in range(0, len(x), decontaminate.PASSAGE)]
        got = []
        for flat, passage, n in decontaminate._passages(column):
            assert sorted(set(passage.tolist())) == list(range(n))
            got += [flat[passage == k].tolist() for k in range(n)]
        assert got == want


def test_passing_over_frequent_words_loses_no_match(monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]  # some words stand nearly everywhere
    items = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 40))) + ".") for k in range(30)]
    vocabulary = decontaminate.Vocabulary(items)
    size = len(vocabulary.number)
    idf = np.array([np.log(1 / weights[words.index(w)]) + 0.1 for w in vocabulary.number])
    vectors = np.random.default_rng(1).standard_normal((size, 20)).astype(np.float32)
    texts = []
    for _ in range(60):
        text = rng.choices(words + [f"x{i}" for i in range(60)], k=rng.randint(0, 120))
        for _, item in rng.sample(items, 2):
            part = [w for w in decontaminate.words_of(item) if rng.random() > 0.2]
            at = rng.randint(0, len(text))
            text[at:at] = part
        texts.append(vocabulary.ids(" ".join(text)))
    found = {}
    for share in (0.0, 0.2):
        monkeypatch.setattr(decontaminate, "FREQUENT", share)
        index = decontaminate.Index(vocabulary, idf, vectors)
        found[share] = [{(no, lcs >= decontaminate.SAME) for no, _, lcs, _, _ in index.matches(t)} for t in texts]
    assert any(found[0.0])
    assert all(a <= b for a, b in zip(found[0.0], found[0.2]))


def test_repeats_are_named(documents):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs = documents((1, base + "x"), (2, "y" * 50 + base[:450]), (3, base[:300]), (4, None), (5, "z" * 900 + base[100:600]))
    got = {r["doc_id"]: (r["has_repeat"], r["longest_repeat"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    # 1 is covered by 2 (0..450) and 5 (100..600); the run of z repeats itself
    assert got[1] == (True, 600, 600) and got[2] == (True, 450, 450)
    assert got[3] == (False, 0, 0) and got[4] == (False, 0, 0) and got[5][0] and got[5][1] >= 900


@pytest.mark.parametrize("chunk", [64, 700, 1 << 20])
def test_words_do_not_depend_on_the_chunk(monkeypatch, chunk):
    suffix_dedup._tables()  # kept: as long as whole chunks need
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(6)
    listed = [rng.choice(["a", "bé", "c" * 63, "c" * 64, "d" * 65, "e" * 900, "if", "the."]) for _ in range(400)]
    text = (" \n" + "".join(w + rng.choice([" ", "\t\r", "\u000b\f\n"]) for w in listed) + "f" * 64).encode()
    listed = [w.encode() for w in [*listed, "f" * 64]]
    name, begin, end = (np.concatenate(x) for x in zip(*suffix_dedup.words(text)))
    assert [text[a:b] for a, b in zip(begin, end)] == listed == text.split()
    assert len(set(name.tolist())) == len(set(listed)) == len(set(zip(name.tolist(), listed)))
    # every window of words lies in one zone, whose stretch names it as the window alone does
    zones = [z for part in suffix_dedup.word_zones(text) for z in zip(*part)]
    n, number = suffix_dedup.WORDS, {a: i for i, a in enumerate(begin.tolist())}
    firsts = [number[z[2]] for z in zones]
    assert firsts[0] == 0 and [number[a] for z in zones for a in begin.tolist() if z[2] <= a and end[min(number[a] + n - 1, len(end) - 1)] <= z[3] and number[a] + n <= len(end)] == list(range(len(listed) - n + 1))
    got, owner, first, stop = suffix_dedup.windows([text[z[2] : z[3]] for z in zones], True)
    assert np.array_equal(got, suffix_dedup.windows([text], True)[0])
    assert [zones[o][2] + a for o, a in zip(owner, first)] == begin[: len(listed) - n + 1].tolist()
    assert [zones[o][2] + b for o, b in zip(owner, stop)] == end[n - 1 :].tolist()


def test_deep_urls_meet_the_same_rules(spark):
    rules = [("com", "/", "allow"), ("b.com", "/x/y/", "block"), ("a.b.com", "/x", "allow"), ("c", "/x/y/z/w", "block")]
    deep = "/".join(str(i) for i in range(3000))
    hosts = ["com", "b.com", "a.b.com", ".".join("z" * 400) + ".a.b.com", "c", "", "d.c"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/y/z", "/x/y/z/w", "/x/y/z/wv/" + deep, "/x/y/" + deep]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()}
    assert url_filter.depths(url_filter.rule_table(spark, rules)) == (3, 4)

    def plain(host, path):
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[3:] if fits else (None, "allow")

    assert [got[i] for i in range(len(urls))] == [plain(h, p) for h in hosts for p in paths]
    none = url_filter.rule_table(spark, [("", "", "block")])
    assert {r["verdict"] for r in url_filter.judge(pages, none).collect()} <= {"allow", "block"}
