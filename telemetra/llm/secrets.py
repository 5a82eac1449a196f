"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Spans are found per kind, leftmost and non-overlapping, as code point offsets (end
exclusive). The value of every span is hashed, and the hashes are counted over the whole
corpus by distinct repository and owner: a value that several owners share is a copied
example, one that a single owner uses and that looks random is a live credential. The span
of a private key is its whole block and its value the base64 body.

Defined cases: null text counts as empty; a null owner or repository counts as one of its
own name (the empty one); equal rows are scanned one by one, but count once per owner; an
empty table gives an empty result; further columns are kept by :func:`redact` and ignored
by :func:`scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import plainly_named, with_row_id, written

# Fixed values of the query: kind, pattern, group that holds the value, least length of it.
BASE_KINDS = [
    ("assign", "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
               "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
]
# Kinds of the method itself.
OWN_KINDS = [
    ("provider", "(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]+", 0, 20),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 30),
    ("keyblock", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
]
KINDS = BASE_KINDS + OWN_KINDS
# A key block goes on to its END line or, without one before the next dashes, over the key
# headers and base64 text that follow. Atomic, so other dashes never stand inside a block.
KEY_LINE = "-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----"
KEY_REST = ("(?:(?>(?s:.*?)(?=-----|\\z))-----END [A-Z ]*PRIVATE KEY-----"
            "|(?:\\s*[A-Za-z][A-Za-z0-9-]*: [^\\r\\n]*[\\r\\n]+){0,4}+[A-Za-z0-9+/=\\s\\\\]*+)")
SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,value:string>>"
# A value used by at least so many distinct owners is a copied example.
COPIED_OWNERS = 3
# A live-looking value has at least so many distinct characters, digits among them.
LIVE_CHARS = 8


def spans_of(text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: the pieces between the matches and the matches give the offsets."""
    header = pattern
    if kind == "keyblock":
        pattern += KEY_REST
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if kind == "keyblock":
        # the base64 text, however its lines are broken; a header with no key has itself
        body = lambda w: F.regexp_replace(F.regexp_replace(w, KEY_LINE, ""), "\\\\[nrt]|[^A-Za-z0-9+/=]", "")
        value = F.transform(whole, lambda w: F.when(F.length(body(w)) >= least, body(w)).otherwise(F.regexp_extract(w, header, 0)))
    size = lambda c: F.length(c).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + size(x["between"])
        end = start + size(x["whole"])
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(
            F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPAN).alias("out"),
            end.alias("at"),
        )

    items = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("between"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.array().cast(SPAN).alias("out"), F.lit(0).cast("bigint").alias("at"))
    found = F.aggregate(items, start, step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, kinds=KINDS) -> Column:
    """Spans of all kinds by start, then kind as listed."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.sort_array(F.concat(*[spans_of(text, no, *k) for no, k in enumerate(kinds)]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def looks_live(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS) & value.rlike("[0-9]") & ~F.lower(value).rlike("example|changeme|placeholder|your_")


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per value hash: distinct owners, distinct repositories, places, and the verdict.

    ``found``: ``_row, _owner, _repo, spans``. Counted once per (hash, owner, repository)
    before the distinct counts, so a value that fills a third of the corpus arrives as
    partial counts.
    """
    each = found.select("_owner", "_repo", F.explode("spans").alias("s"))
    keyed = each.groupBy(F.sha2("s.value", 256).alias("hash"), "_owner", "_repo").agg(
        F.count(F.lit(1)).alias("places"), F.max(looks_live(F.col("s.value"))).alias("random"))
    by_owner = keyed.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("places").alias("places"), F.max("random").alias("random"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("places").alias("places"),
        ((F.count(F.lit(1)) < copied_owners) & F.max("random")).alias("live"),
    )


def find(rows: DataFrame, *, keep: dict[str, str] | None = None, text_col: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """``rows`` (with ``_row``) → ``_row, _owner, _repo, spans`` and the columns of ``keep``
    (new name → column). Owner and repository are the source and its language by default."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    return rows.select(
        "_row", F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("_repo"),
        all_spans(F.col(text_col)).alias("spans"), *[F.col(c).alias(n) for n, c in (keep or {}).items()],
    )


def classified(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per row with spans: ``_row, live`` (its live spans by start), ``n_live``, ``n_copied``."""
    verdicts = ownership(found, copied_owners)
    each = found.select("_row", F.explode("spans").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    judged = each.join(verdicts.select("hash", F.col("live").alias("is_live"), (F.col("owners") >= copied_owners).alias("copied")), "hash")
    return judged.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_live"), F.col("s")))).alias("live"),
        F.sum(F.col("is_live").cast("bigint")).alias("n_live"),
        F.sum(F.col("copied").cast("bigint")).alias("n_copied"),
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per document: id, spans of all kinds and the ownership verdicts."""
    found = written(find(with_row_id(docs), keep={"_id": id_col}), "secret-spans")
    return found.join(classified(found, copied_owners), "_row", "left").select(
        F.col("_id").alias(id_col), "spans",
        F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"),
    )


def masked(text: Column, live: Column) -> Column:
    """``text`` with each run of overlapping live spans replaced by ``[secret]``."""
    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("[secret]"))
        return F.struct(F.when(apart, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    return F.aggregate(live, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1)))


def redact(docs: DataFrame, *, text_col: str = "text", size_col: str = "n_chars", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Pipeline form: every document stays, its live credentials are masked.

    Only documents that hold a span are written and meet the verdicts in a join; all others
    go straight through.
    """
    plain, name = plainly_named(docs), lambda c: f"c{docs.columns.index(c)}"
    body, source = F.col(name(text_col)), F.col(name("source"))
    suspect = F.coalesce(body, F.lit("")).rlike("|".join(f"(?:{p})" for _, p, _, _ in KINDS))
    rows = written(with_row_id(plain.where(suspect)), "secret-rows")
    spans = find(rows, text_col=name(text_col), owner=source, repo=F.concat_ws("/", source, F.col(name("lang"))))
    live = classified(written(spans, "secret-spans"), copied_owners).where("n_live > 0").select("_row", "live")
    changed = rows.join(live, "_row", "left")
    text = F.when(F.col("live").isNotNull(), masked(body, F.col("live"))).otherwise(body)
    changed = changed.withColumn(name(text_col), text)
    if size_col in docs.columns:
        size = F.length(body).cast(docs.schema[size_col].dataType)
        changed = changed.withColumn(name(size_col), F.when(F.col("live").isNotNull(), size).otherwise(F.col(name(size_col))))
    return plain.where(~suspect).unionByName(changed.select(plain.columns)).toDF(*docs.columns)
