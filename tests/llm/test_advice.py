"""Cases of the second advice, each with a result that earlier code cut short."""

import random

import numpy as np
import pytest

from telemetra.llm import decontaminate, html_extract, secrets
from telemetra.llm.common import table

from llm_fixtures import documents  # noqa: F401

SMALL = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- 9 decontamination

def altered_items(index, rate, seed):
    """(item, text) with ``rate`` of the item's words replaced by outside words, between other
    words, where the items' order still tells."""
    rng = random.Random(seed)
    for no, item in enumerate(index.item_ids):
        held = item.copy()
        held[rng.sample(range(len(item)), round(rate * len(item)))] = -1
        if decontaminate.common(item.tolist(), held.tolist()) >= decontaminate.SAME * len(item):
            around = [rng.choice([-1, rng.randrange(len(index.vocabulary.number))]) for _ in range(60)]
            yield no, np.array([*around[:30], *held, *around[30:]], dtype=np.int32)


@pytest.fixture(scope="module")
def index_at(spark):
    """The index over the small corpus, its passages counted ``times`` as often."""
    vocabulary = decontaminate.Vocabulary(decontaminate.benchmark_items(table(spark, SMALL, "benchmark")))
    numbers = decontaminate.word_numbers(table(spark, SMALL, "documents"), vocabulary)
    real = decontaminate.document_frequencies

    def make(times):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(decontaminate, "document_frequencies", lambda n, size: tuple(x * times for x in real(n, size)))
            return decontaminate.build(numbers, vocabulary)

    return make


@pytest.mark.parametrize("times", [1, 30_000])
def test_replaced_words_are_found_at_any_corpus_size(index_at, times):
    index = index_at(times)
    for rate, least in ((0.1, 0.95), (0.15, 0.95), (0.2, 0.95), (0.25, 0.9)):
        found = [no in {m[0] for m in index.matches(ids)} for no, ids in altered_items(index, rate, 3)]
        assert np.mean(found) >= least, (rate, np.mean(found), len(found))


def test_every_window_is_searched(index_at):
    """Against all pairs of windows: no place that a verdict could accept is left out."""
    index = index_at(1)
    seen = 0
    for no, ids in altered_items(index, 0.2, 8):
        item = index.item_ids[no]
        size, slack = min(decontaminate.WINDOW, len(item)), max(4, len(item) // 4)
        cut = lambda x, at: index.vectors[[t for t in x[at : at + size] if t >= 0]].sum(0)
        got = {start for start, _ in index.candidates(ids).get(no, [])}
        for i in range(len(ids) - size + 1):
            if (ids[i : i + size] >= 0).sum() * decontaminate.KNOWN < size:
                continue
            for j in range(len(item) - size + 1):
                a, b = cut(ids, i), cut(item, j)
                part = ids[max(0, i - j - slack) : max(0, i - j + len(item) + slack)].tolist()
                if a @ b >= (decontaminate.COSINE + 1e-4) * np.linalg.norm(a) * np.linalg.norm(b) \
                        and decontaminate.common(item.tolist(), part) >= decontaminate.SAME_WITH_ANSWER * len(item):
                    assert i - j in got, (no, i, j)
                    seen += 1
    assert seen > 1000


def test_search_in_pieces_equals_the_whole(index_at, monkeypatch):
    index = index_at(1)
    texts = [ids for _, ids in altered_items(index, 0.1, 4)]
    text = np.concatenate(texts)
    whole = [m[0] for m in index.matches(text)]
    monkeypatch.setattr(decontaminate, "PAIRS", 300)
    assert [m[0] for m in index.matches(text)] == whole and len(whole) >= 0.95 * len(texts)


# ---------------------------------------------------------------- 10 secrets

def key_block(seed, end="-----END RSA PRIVATE KEY-----", line="\n"):
    rng = random.Random(seed)
    body = ["".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=64)) for _ in range(5)]
    return line.join(["-----BEGIN RSA PRIVATE KEY-----", *body, end])


def test_private_keys_are_judged_and_masked_by_their_body(documents):
    sample = key_block(0)
    rows = [(i, f"see {sample} here", "en", f"s{i}") for i in range(4)]
    rows += [(10 + i, f"mine {key_block(10 + i)} stays", "en", f"s{i}") for i in range(4)]
    rows += [(20, "cut off " + key_block(20, end=""), "en", "s1"), (21, "json " + key_block(21, line="\\n") + " stays", "en", "s1")]
    rows += [(30, "starts with '-----BEGIN RSA PRIVATE KEY-----', see version 12 of this text", "en", "s1")]
    rows += [(31, "'-----BEGIN PRIVATE KEY-----' and " + key_block(31) + " stays", "en", "s1")]
    rows += [(32, "Proc " + key_block(32).replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n", 1) + " stays", "en", "s1")]
    rows += [(33, "crlf " + key_block(0, line="\r\n") + " here", "en", "s9")]
    docs = documents(*rows)
    got = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in secrets.scan(docs).collect() if r["doc_id"] not in (30, 31)}
    assert got == {**{i: (0, 1) for i in (0, 1, 2, 3, 33)}, **{i: (1, 0) for i in (10, 11, 12, 13, 20, 21, 32)}}
    text = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(text[i] == f"see {sample} here" for i in range(4)) and text[30] == rows[10][1]
    assert all(text[10 + i] == "mine [secret] stays" for i in range(4))
    assert (text[20], text[21], text[32]) == ("cut off [secret]", "json [secret] stays", "Proc [secret] stays")
    assert text[31] == "'-----BEGIN PRIVATE KEY-----' and [secret] stays"


def test_a_key_header_before_many_dashes(documents):
    text = "-----BEGIN PRIVATE KEY-----'" + " -- - ---" * 200_000
    assert [len(r["spans"]) for r in secrets.scan(documents((1, text))).collect()] == [1]


# ---------------------------------------------------------------- 8 HTML extraction

@pytest.mark.parametrize("copies", [1, 2, 40])
def test_copies_do_not_hide_the_boilerplate(spark, copies):
    menu = "".join(f"<p>Menu {i}</p>" for i in range(9))
    page = lambda k: f"<body>{menu}<p>{f'own text of page {k} that no other page has, ' * 6}</p></body>"
    rows = [(k * 100 + c, f"http://a.org/{k}/{c:03}", page(k)) for k in range(4) for c in range(copies)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    got = {r["page_id"]: [x[:18] for x in r["lines"]] for r in html_extract.extract(pages).collect()}
    assert got == {i: [f"own text of page {i // 100}"] for i, _, _ in rows}
