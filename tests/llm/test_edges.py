"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from telemetra.llm import decontaminate, html_extract, langid, license_scan, minhash, packing, quality_rules, secrets, suffix_dedup, url_filter
from telemetra.llm.queries import tokenizer

from llm_fixtures import documents  # noqa: F401

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, "short text"), (3, "short text"), (None, "short text"), (4, LONG), (5, "   \n\n "), (6, "password = abcdefgh12345678 \U0001f600", None, None)]


def run_all(docs, benchmark):
    path = tokenizer("word_bpe_49k.json")
    model = langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 15)
    return {
        "quality": quality_rules.score(docs), "licenses": license_scan.scan(docs, license_scan.TEMPLATES), "suffix": suffix_dedup.remove_repeats(docs),
        "near": minhash.detect(docs), "language": langid.identify(docs, model), "leaks": decontaminate.find(docs, benchmark),
        "secrets": secrets.scan(docs), "pack": packing.pack(docs, path),
    }


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(0, "one two three four. five six"), (1, None), (2, "")], "item_id bigint, text string")


def test_odd_rows_have_defined_results(documents, benchmark):
    out = {k: v.collect() for k, v in run_all(documents(*ROWS), benchmark).items()}
    for name in ("quality", "licenses", "suffix", "near", "language", "secrets"):
        assert sorted(str(r["doc_id"]) for r in out[name]) == sorted(str(r[0]) for r in ROWS), name
    by = {r["doc_id"]: r for r in out["quality"]}
    assert by[1]["base_failed"] and not by[1]["kept"] and by[1]["n_words"] == 0 and by[5]["n_words"] == 0
    near = [(r["doc_id"], r["class_id"]) for r in out["near"]]
    assert near.count((3, 3)) == 2 and (None, 3) in near and (1, 1) in near and (2, 2) in near
    assert {r["lang_pred"] for r in out["language"] if r["doc_id"] in (1, 2, 5)} == {"und"}
    assert [r["n_live"] for r in out["secrets"] if r["doc_id"] == 6] == [1]
    assert out["leaks"] == []
    pieces = [r for r in out["pack"] if r["doc_id"] == 1]
    assert [(p["piece"], p["start"], p["length"]) for p in pieces] == [(0, 0, 1)]


def test_empty_tables(spark, documents, benchmark):
    none = documents((1, "x")).limit(0)
    assert all(v.count() == 0 for v in run_all(none, benchmark).values())
    assert quality_rules.keep(none).count() == minhash.keep_one(none).count() == secrets.redact(none).count() == 0
    assert decontaminate.find(documents((1, "a b c")), benchmark.limit(0)).count() == 0
    assert decontaminate.keep_clean(documents((1, "a b c")), benchmark.limit(0)).count() == 1
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract(pages).count() == 0
    assert url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_pipeline_forms_keep_all_columns(documents, benchmark):
    docs, clashing = documents(*ROWS), ("label", "_stats", "_pair", "_key", "_size", "_bands", "_kept", "live", "_id", "node", "spans", "c0")
    for name in clashing:
        docs = docs.withColumn(name, F.lit("more"))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert decontaminate.keep_clean(docs, benchmark).columns == docs.columns
    prose = documents((1, " ".join(f"word{i % 90}" for i in range(200))), (2, "too short"))
    for name in clashing:
        prose = prose.withColumn(name, F.lit("more"))
    good = quality_rules.keep(prose)
    assert good.columns == prose.columns
    for found in (kept, secrets.redact(docs), good):
        assert all(r[c] == "more" for r in found.collect() for c in ("_row", *clashing))
    masked = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert masked[6]["text"] == "[secret] \U0001f600" and masked[6]["n_chars"] == 10
    assert masked[4]["text"] == LONG
