"""Quality rules: base rules on counts, then robust multivariate outliers.

Every text becomes a vector of transformed statistics. Per group (language and source) the
minimum-covariance-determinant estimate of location and scatter is fitted over all rows
that pass the base rules, and a row is rejected when its Mahalanobis distance from its
group's estimate exceeds a chi-squared quantile.

The fit is Spark aggregation over a narrow table of statistics: deterministic starts
(coordinate medians with MADs, classical moments, moments of tanh scores), then
concentration steps. A step bins each row's distance (``BINS`` bins an octave), sums
moments per (group, start, bin) and, per group, takes the bins up to the ``SUPPORT``
quantile, the last one in part; a hot group reaches the group step as bins, not rows.

Defined cases: a null or empty text has zero counts, fails the base rules and is not kept.
Null languages and sources are values of their own. A group with fewer than ``LEAST_ROWS``
rows joins the pool of its language, that pool the pool of all if it is small too, and a
pool still too small rejects nothing. Repeated rows are judged alike; an empty table gives
an empty result; further columns pass through :func:`keep` and are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm.common import WORD, map_rows, plainly_named, written

# Fixed values of the base rules.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"

# Part of a group that the estimate rests on, and the chi-squared probability of the cutoff.
SUPPORT, CUTOFF = 0.75, 0.999999
LEAST_ROWS, BINS, MAX_STEPS = 60, 16, 12
# Words of prior evidence mixed into each ratio, so that short texts vary no more than long
# ones, and the least standard deviation of each transformed statistic.
PRIOR_WORDS, PRIOR_LENGTH = 50, 5.0
FLOOR = [0.06, 0.25, 0.25, 0.25, 0.25, 0.25]
P = len(FLOOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, x array<double>"
_WORD = re.compile(WORD)
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
_PUNCT = re.compile("[^\\w\\s]")
_BLANK = " \t\n\v\f\r"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that occur at least twice in the text, the first one included.

    Exact: windows of 1, 2, 4, ... words are named by their rank among the text's own."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    names = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    size = 1
    while size < window:
        step = min(size, window - size)
        pairs = names[:-step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        size += step
    twice = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple:
    """The counts of one text, the base verdict and the transformed vector."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeat > REPEAT_PERCENT * n
    room = chars + PRIOR_WORDS * PRIOR_LENGTH
    x = [
        math.log(room / (n + PRIOR_WORDS)),
        math.log1p(100 * symbols / room),
        math.log1p(100 * len(_UPPER.findall(text)) / room),
        math.log1p(10 * dup / (len(lines) + 5)),
        math.log1p(10 * repeat / (n + PRIOR_WORDS)),
        math.log1p(100 * len(_PUNCT.findall(text)) / room),
    ]
    return n, chars, symbols, dup, repeat, failed, x


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "_stats") -> DataFrame:
    """``docs`` with a struct column of counts and vector, computed over whole texts."""
    kind = T._parse_datatype_string(COUNTS)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])
    at, names = docs.columns.index(text_col), kind.names

    def fn(cols: list[list]) -> list[list]:
        return [*cols, [dict(zip(names, statistics(t))) for t in cols[at]]]

    return map_rows(docs, schema, fn)


def chi2_cdf(x: float, p: int) -> float:
    """Chi-squared distribution for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, p // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return (lo + hi) / 2


def consistency(support: float = SUPPORT, p: int = P) -> float:
    """Factor that makes the scatter of the closest part consistent for normal data."""
    return support / chi2_cdf(chi2_quantile(support, p), p + 2)


def estimate(n: float, first: np.ndarray, second: np.ndarray, scale: float = 1.0) -> tuple[list, list, float]:
    """Location, precision (upper triangle) and log determinant from moment sums; each
    variance is at least the square of its floor."""
    mean = first / n
    cov = np.zeros((P, P))
    for (i, j), s in zip(PAIRS, second):
        cov[i, j] = cov[j, i] = (s / n - mean[i] * mean[j]) * scale
    cov += np.diag(np.square(FLOOR))
    inv = np.linalg.inv(cov)
    return mean.tolist(), [float(inv[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


def distance(x: Column, mean: Column, prec: Column) -> Column:
    """Squared Mahalanobis distance as plain arithmetic."""
    d = [x[i] - mean[i] for i in range(P)]
    total = None
    for k, (i, j) in enumerate(PAIRS):
        term = prec[k] * d[i] * d[j] * (1.0 if i == j else 2.0)
        total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


PARAMS = "grp string, start int, mean array<double>, prec array<double>, logdet double, n double"


def _moments(x: Column) -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("n"),
            F.array(*[F.sum(x[i]) for i in range(P)]).alias("first"),
            F.array(*[F.sum(x[i] * x[j]) for i, j in PAIRS]).alias("second")]


def _starts(rows: DataFrame) -> DataFrame:
    """Three starting estimates per group, each from one aggregation."""
    mids = rows.groupBy("grp").agg(*[F.percentile_approx(F.col("x")[i], 0.5, 2000).alias(f"m{i}") for i in range(P)])
    mids = written(mids.select("grp", F.array(*[f"m{i}" for i in range(P)]).alias("med")), "mcd-mid")
    off = rows.join(mids, "grp")
    mads = off.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("med")[i]), 0.5, 2000).alias(f"m{i}") for i in range(P)])
    mads = written(mids.join(mads, "grp").select("grp", "med", F.array(*[F.greatest(F.col(f"m{i}") * 1.4826, F.lit(FLOOR[i])) for i in range(P)]).alias("mad")), "mcd-mad")
    score = F.array(*[F.tanh((F.col("x")[i] - F.col("med")[i]) / F.col("mad")[i]) for i in range(P)])
    both = rows.join(mads, "grp").select("grp", "med", "mad", F.explode(F.array(
        F.struct(F.lit(1).alias("start"), F.col("x").alias("v")), F.struct(F.lit(2).alias("start"), score.alias("v")))).alias("e"))
    sums = both.groupBy("grp", "e.start").agg(F.first("med").alias("med"), F.first("mad").alias("mad"), *_moments(F.col("e.v")))

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                n, first, second = r.n, np.array(r.first), np.array(r.second)
                med, mad = np.array(r.med), np.array(r.mad)
                if r.start == 2:  # correlations of the scores, spread by the MADs
                    m = first / n
                    c = np.zeros((P, P))
                    for (i, j), s in zip(PAIRS, second):
                        c[i, j] = c[j, i] = s / n - m[i] * m[j]
                    sd = np.sqrt(np.diag(c) + 1e-6)
                    c = c / sd[:, None] / sd[None, :]
                    np.fill_diagonal(c, 1.0)
                    c = 0.9 * c + 0.1 * np.eye(P)
                    inv = np.linalg.inv(c * mad[:, None] * mad[None, :])
                    out.append((r.grp, 2, med.tolist(), [float(inv[i, j]) for i, j in PAIRS], 0.0, n))
                else:
                    out.append((r.grp, 1, *estimate(n, first, second), n))
                    inv = np.diag(1 / mad**2)
                    out.append((r.grp, 0, med.tolist(), [float(inv[i, j]) for i, j in PAIRS], 0.0, n))
            yield pd.DataFrame(out, columns=["grp", "start", "mean", "prec", "logdet", "n"])

    return written(sums.mapInPandas(fit, PARAMS), "mcd-start")


def _concentrate(rows: DataFrame, params: DataFrame, support: float, last: bool = False) -> DataFrame:
    """One concentration step for every start in ``params``."""
    d2 = distance(F.col("x"), F.col("mean"), F.col("prec"))
    binned = rows.join(params.select("grp", "start", "mean", "prec"), "grp").select(
        "grp", "start", "x", F.floor(F.log2(d2 + F.lit(1e-9)) * BINS).cast("int").alias("bin"))
    sums = binned.groupBy("grp", "start", "bin").agg(*_moments(F.col("x")))
    scale = consistency(support) if last else 1.0

    def closest(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        n = part["n"].to_numpy()
        h = support * n.sum()
        share = np.clip((h - (np.cumsum(n) - n)) / n, 0, 1)
        first = (np.stack(part["first"]) * share[:, None]).sum(0)
        second = (np.stack(part["second"]) * share[:, None]).sum(0)
        return pd.DataFrame([(key[0], int(key[1]), *estimate(h, first, second, scale), float(n.sum()))],
                            columns=["grp", "start", "mean", "prec", "logdet", "n"])

    return written(sums.groupBy("grp", "start").applyInPandas(closest, PARAMS), "mcd-step")


def pair_of(lang: Column, source: Column) -> Column:
    """Language and source as one text; nulls are values of their own."""
    return F.to_json(F.struct(lang.alias("lang"), source.alias("source")), {"ignoreNullFields": "false"})


def group_names(stats: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """``pair, grp``: the group each pair is fitted in (its own or a pool)."""
    pool = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    sizes = stats.groupBy("pair").agg(F.first("lang").alias("lang"), F.count(F.lit(1)).alias("n"))
    named = sizes.withColumn("g", F.when(F.col("n") >= least, F.col("pair")).otherwise(pool))
    pools = named.groupBy("g").agg(F.sum("n").alias("rows"))
    return named.join(pools, "g").select("pair", F.when(F.col("rows") >= least, F.col("g")).otherwise(F.lit("all")).alias("grp"))


def fit(stats: DataFrame, *, support: float = SUPPORT, least: int = LEAST_ROWS) -> DataFrame:
    """``pair, mean, prec``: the estimate each pair is held against, from ``pair, lang, x`` rows.

    Two steps for all starts, then the start of the least determinant until the
    determinants stand still (one number reaches the driver per step)."""
    names = written(group_names(stats, least), "mcd-groups")
    rows = written(stats.join(names, "pair").select("grp", "x"), "mcd-rows")
    params = _starts(rows)
    for _ in range(2):
        params = _concentrate(rows, params, support)
    best = params.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "prec", "logdet", "n"), F.struct("logdet", "start")).alias("b"))
    params = written(best.select("grp", "b.*"), "mcd-best")
    for _ in range(MAX_STEPS):
        new = _concentrate(rows, params, support)
        moved = new.join(params.select("grp", F.col("logdet").alias("before")), "grp").agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        params = new
        if moved is None or moved < 1e-3:
            break
    params = _concentrate(rows, params, support, last=True).where(F.col("n") >= least)
    return written(names.join(params, "grp").select("pair", "mean", "prec"), "mcd-fit")


def judge(rows: DataFrame, fitted: DataFrame, stats: str = "_stats", cutoff: float = CUTOFF) -> DataFrame:
    """``rows`` (with ``_pair`` and the statistics struct) plus ``_distance`` and ``_kept``."""
    held = rows.join(fitted.select(F.col("pair").alias("_pair"), F.col("mean").alias("_mean"), F.col("prec").alias("_prec")), "_pair", "left")
    d2 = distance(F.col(f"{stats}.x"), F.col("_mean"), F.col("_prec"))
    near = F.coalesce(d2 <= chi2_quantile(cutoff, P), F.lit(True))
    return held.withColumn("_distance", F.sqrt(F.when(F.col("_mean").isNotNull(), d2))).withColumn("_kept", ~F.col(f"{stats}.base_failed") & near).drop("_mean", "_prec")


def score(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``kept`` and ``distance``."""
    rows = docs.select(F.col(id_col).alias("_id"), "text", "lang", "source")
    stats = with_statistics(rows).select("_id", "lang", pair_of(F.col("lang"), F.col("source")).alias("_pair"), "_stats")
    stats = written(stats, "quality-statistics")
    fitted = fit(_passing(stats))
    return judge(stats, fitted).select(F.col("_id").alias(id_col), "_stats.*", F.col("_kept").alias("kept"), F.col("_distance").alias("distance")).drop("x")


def _passing(stats: DataFrame) -> DataFrame:
    return stats.where("not _stats.base_failed").select(F.col("_pair").alias("pair"), "lang", F.col("_stats.x").alias("x"))


def keep(docs: DataFrame) -> DataFrame:
    """Pipeline form: the kept rows of ``docs``, all columns. The texts are read twice, once
    for the fit and once to be judged, and never shuffled."""
    plain = plainly_named(docs)
    text, lang, source = (f"c{docs.columns.index(c)}" for c in ("text", "lang", "source"))
    pair = pair_of(F.col(lang), F.col(source))
    own = plain.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = written(with_statistics(own).select("lang", pair_of(F.col("lang"), F.col("source")).alias("_pair"), "_stats"), "quality-statistics")
    fitted = fit(_passing(stats))
    judged = judge(with_statistics(plain, text).withColumn("_pair", pair), fitted)
    return judged.where("_kept").select(plain.columns).toDF(*docs.columns)
