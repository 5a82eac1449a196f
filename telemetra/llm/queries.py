"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import (
    conversation_sql,
    decontaminate,
    html_extract,
    langid,
    license_scan,
    minhash,
    packing,
    prefix_trie,
    quality_rules,
    secrets,
    shortest_pack,
    structure_repair,
    suffix_dedup,
    url_filter,
)
from telemetra.llm.common import table


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file of this machine; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and robust-outlier verdict per document."""
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and accepted license templates per document."""
    templates = [(label, phrase) for phrase, label in license_scan.BASE] + license_scan.TEMPLATES
    n_base = len(license_scan.BASE)
    names = F.array(*[F.lit(label) for label, _ in templates])
    base = F.filter("places", lambda p: p["template"] < n_base)
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.element_at(names, p["template"] + 1)))), ",")
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), lambda acc, p: F.struct(
        (acc["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(acc["at"], p["start"]))).alias("n"), F.greatest(acc["at"], p["end"]).alias("at")))["n"]
    docs = license_scan.scan(table(spark, sf_dir, "documents"), templates)
    return docs.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(covered / F.when(F.col("n_words") > 0, F.col("n_words")), F.lit(0.0)).alias("score"),
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated 400-byte strings are removed."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per page URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and the slots they are packed into."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class per document."""
    return minhash.detect(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(langid.sample(docs)))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text per page."""
    text = F.array_join("lines", "\n")
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, benchmark item) pairs: the item stands in the document."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans per document, and how many are live or copied by the corpus' owners."""
    docs = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return docs.select(
        "doc_id", *[count(k) for k, *_ in secrets.BASE_KINDS],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its audit per conversation, after the query's damage."""
    return structure_repair.repair(structure_repair.damage(table(spark, sf_dir, "conversations")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt_keys(prefix_trie.turn_ids(table(spark, sf_dir, "conversations"))))


def op13_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in padded sequences."""
    return shortest_pack.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def _op4_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES {rules}),
best AS (SELECT u.r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN best USING (r)"""


def _op10_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = []
    for no, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        p = quote(pattern)
        kinds.append(f"""
SELECT r, {no} AS kind_no, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(w) + 1), lambda i: {{
  's': list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0)::BIGINT,
  'n': length(w[i])::BIGINT, 'v': v[i]}}), lambda y: length(y.v) >= {least})) AS y
FROM (SELECT r, string_split_regex(t, {p}) AS b, regexp_extract_all(t, {p}) AS w, regexp_extract_all(t, {p}, {group}) AS v FROM d WHERE regexp_matches(t, {p}))""")
    n_base = len(secrets.BASE_KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o FROM documents),
spans AS (SELECT r, kind_no, kind, y.s AS s, y.s + y.n AS e, y.v AS v FROM ({' UNION ALL '.join(kinds)})),
owners AS (SELECT v, count(DISTINCT o) AS owners,
  bool_or(len(list_distinct(string_split(v, ''))) >= {secrets.LIVE_CHARS} AND regexp_matches(v, '[0-9]')
          AND NOT regexp_matches(lower(v), 'example|changeme|placeholder|your_')) AS random
  FROM spans JOIN d USING (r) GROUP BY v),
agg AS (SELECT r,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind_no < {n_base}) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans,
  count(*) FILTER (owners < {secrets.COPIED_OWNERS} AND random) AS n_live, count(*) FILTER (owners >= {secrets.COPIED_OWNERS}) AS n_copied
  FROM spans JOIN owners USING (v) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN agg USING (r)"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scans": op2_license_scans,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_html_extraction": op8_html_extraction,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_secret_scans": op10_secret_scans,
    "op11_structure_repair": op11_structure_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_shortest_pack": op13_shortest_pack,
}

ORACLE = {
    "op4_url_filters": _op4_sql(),
    "op10_secret_scans": _op10_sql(),
    "op11_structure_repair": conversation_sql.STRUCTURE_REPAIR,
    "op12_prefix_trie": conversation_sql.PREFIX_TRIE,
}
