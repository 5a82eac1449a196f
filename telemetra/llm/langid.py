"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word stands for itself and its character n-grams, each hashed into a bucket with an
embedding; a text is the mean over the n-grams of all its words, and a linear layer with a
softmax gives the languages. Embeddings and layer are trained together by stochastic
gradient descent in numpy on at most ``SAMPLE`` labelled rows (those of the least hash of
id and text, so the choice is the same at every run). A temperature and a rejection
threshold are fitted on a part of that sample which the descent does not see.

Scoring is linear, so a bucket's embedding times the layer is one small row per bucket; a
task adds those rows up per distinct word and then per text. Whole texts are scored.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not
accepted. Rows without a label or with a null id are never learned from; without any
labelled row all texts are ``und``. Repeated rows are scored alike; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labelled rows that the classifier is fitted on, at most.
SAMPLE = 2000
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 15, 16, 5, 0.5, 7
NGRAMS = (1, 2, 3, 4)
# Share of the sample kept for the temperature, and of its right answers that rejection may lose.
CALIBRATION, MAY_LOSE = 0.2, 0.01
CACHE_WORDS = 300_000

_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows kept for the test: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets_of(word: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a word's n-grams, the word bounded by ``<`` and ``>``, and of the word itself."""
    w = f"<{word}>"
    grams = [w] + [w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)]
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams], dtype=np.int64)


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


class Model:
    """Trained embeddings and layer; ``languages`` in sorted order."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.threshold = temperature, threshold
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages) + 1))

    def __getstate__(self):
        return self.__dict__ | {"index": {}, "rows": self.rows[:0]}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def _learn(self, word: str) -> None:
        """Keep a word's summed bucket rows and its number of n-grams."""
        at = buckets_of(word, len(self.table))
        n = len(self.index)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n, :-1], self.rows[n, -1] = self.table[at].sum(0), len(at)
        self.index[word] = n

    def logits(self, text: str | None) -> np.ndarray | None:
        """Mean of the buckets' rows over all n-grams of the text; ``None`` without letters."""
        words = words_of(text)
        if not words or not self.languages:
            return None
        if len(self.index) > CACHE_WORDS:
            self._forget()
        for word in set(words).difference(self.index):
            self._learn(word)
        total = self.rows[np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))].sum(0)
        return total[:-1] / total[-1] + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is accepted."""
        z = self.logits(text)
        if z is None:
            return "und", 0.0, False
        p = softmax(z[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(min(p[best], 1.0)), bool(p[best] >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def features(text: str | None, buckets: int = BUCKETS, memo: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their share of all its n-grams."""
    memo = {} if memo is None else memo
    weight: Counter = Counter()
    for word, times in Counter(words_of(text)).items():
        if word not in memo:
            memo[word] = buckets_of(word, buckets).tolist()
        for b in memo[word]:
            weight[b] += times
    at = np.fromiter(weight, dtype=np.int64, count=len(weight))
    share = np.fromiter(weight.values(), dtype=np.float64, count=len(weight))
    return at, share / max(1.0, share.sum())


def train(rows: list[tuple[str, str]], *, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit on (text, language) rows by stochastic gradient descent, then calibrate."""
    languages = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    rng, memo = np.random.default_rng(seed), {}
    data = [(*features(text, buckets, memo), number[lang]) for text, lang in rows]
    data = [d for d in data if len(d[0])]
    embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    layer, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    kept = max(1, int(len(data) * CALIBRATION)) if len(data) >= 20 else 0
    order = rng.permutation(len(data))
    check, learn = order[:kept], order[kept:]
    steps, done = epochs * max(1, len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, share, y = data[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ embed[at]
            p = softmax((hidden @ layer + bias)[None, :])[0]
            p[y] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * p
            # a bucket's step follows its share; scaled up, for shares of long texts are small
            embed[at] -= lr * np.outer(share * min(len(share), 200), back)
    model = Model(languages, (embed @ layer).astype(np.float64), bias)
    if kept:
        z = np.stack([data[i][1] @ model.table[data[i][0]] + bias for i in check])
        y = np.array([data[i][2] for i in check])
        # a little doubt in each label (Laplace), or separable classes would drive it to 0
        doubt = 1 / (len(y) + 2)
        target = np.full(z.shape, doubt / max(1, len(languages) - 1))
        target[np.arange(len(y)), y] = 1 - doubt
        loss = lambda t: -(target * np.log(softmax(z / t) + 1e-300)).sum(1).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y]
        model.threshold = float(np.quantile(right, MAY_LOSE)) if len(right) else 0.0
    return model


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE) -> list[tuple[str, str]]:
    """The labelled rows that are learned from: at most ``size``, those of the least hash of
    id and text. Rows are counted first, so that about twice as many as needed are ordered
    and the driver receives no more than those, however many tasks there are."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 32)).alias("h"))
    reach = min(1.0, (2 * size + 100) / max(1, rows.count()))
    near = rows.where(F.col("h") <= int(reach * (1 << 32)))
    return [(r["text"], r["lang"]) for r in near.orderBy("h", "text", "lang").limit(size).collect()]


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out, lang_pred, score, accepted``."""
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets × languages, bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(2).to_pylist()] or [()] * 0
            lang, score, ok = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
                names=schema.names)

    return rows.mapInArrow(run, schema)
