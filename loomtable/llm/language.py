"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1-, 2- and 3-grams of the lower-cased text.
Document frequencies are counted over all training documents.  Weights are
learned by follow-the-regularised-leader with elastic-net penalties on a
bounded sample (SAMPLE_PER_LANGUAGE rows a language, chosen by hash); a part
of it is left out of that and sets the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtable.llm.common import bounded_batches, id_crc, pieces, trim, trimmed

#: Hashed features; n-gram lengths; documents scored at once.
DIMS, ORDERS, CHUNK = 1 << 15, (1, 2, 3), 64
#: Bound of the training sample, a language; languages at most.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 1000, 512
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader, proximal form, for softmax regression."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    epochs: int = 4

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, dims: int) -> np.ndarray:
        z, n = np.zeros((dims, classes)), np.zeros((dims, classes))
        order = np.random.default_rng(3)
        for _ in range(self.epochs):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                zi, ni = z[at], n[at]
                w = self._weights(zi, ni)
                p = softmax(x @ w)
                p[labels[i]] -= 1.0
                g = x[:, None] * p[None, :]
                n[at] = ni + g * g
                z[at] = zi + g - (np.sqrt(n[at]) - np.sqrt(ni)) / self.alpha * w
        return self._weights(z, n)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits under which the labels are likeliest: golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found, key = [], np.zeros(len(code), np.uint32)
    for k, order in enumerate(ORDERS):
        if len(code) < order:
            break
        # the key of n characters from that of n - 1
        key = (key[: len(code) - order + 1] + code[order - 1 :] + np.uint32(k + 1)) * _MIX[k]
        key ^= key >> np.uint32(15)
        found.append((key * _MIX[0]) >> np.uint32(17))
    return np.bincount(np.concatenate(found), minlength=DIMS) if found else np.zeros(DIMS, np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _training(every: int) -> Column:
    return F.coalesce(id_crc(F.col("doc_id")) % every != 0, F.lit(False)) & F.col("lang").isNotNull()


_LEARN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])
_PARTS = 32


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's texts in _PARTS rows, and the counts of sampled texts."""
    df, docs = np.zeros(DIMS, np.int64), 0
    seen: set[tuple[str, int]] = set()  # a repeated row is sampled once
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("key", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])
    for batch, texts in pieces(batches, 0):
        rows = []
        for x, lang, chosen, key in zip(texts, *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            c = counts(x.decode("utf-8", "replace"))
            df += c > 0
            docs += 1
            if chosen and (lang, key) not in seen:
                seen.add((lang, key))
                at = np.flatnonzero(c)
                rows.append({"kind": "row", "part": 0, "key": key, "lang": lang, "at": at.astype("<u2").tobytes(), "n": c[at].astype("<u4").tobytes()})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    step = DIMS // _PARTS
    rows = [{"kind": "df", "part": k, "key": None, "lang": None, "at": int(docs).to_bytes(8, "little"), "n": df[k * step : (k + 1) * step].astype("<i8").tobytes()} for k in range(_PARTS)]
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _sum_parts(group):
    import pandas as pd

    total = np.sum([np.frombuffer(x, "<i8") for x in group["n"]], axis=0)
    docs = sum(int.from_bytes(x, "little") for x in group["at"])
    return pd.DataFrame({"part": [int(group["part"].iloc[0])], "docs": [docs], "n": [total.astype("<i8").tobytes()]})


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMS rows of idf * weight a language
    bias: np.ndarray
    idf2: np.ndarray  # squares, for the norm of a document's vector
    temperature: float

    def predict(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and probability of the likeliest language for rows of counts."""
        x = found.astype(np.float32)
        norm = np.sqrt(np.maximum((x * x) @ self.idf2, 1e-12))
        p = softmax(((x @ self.weights) / norm[:, None] + self.bias).astype(np.float64) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def train(docs: DataFrame, every: int = 5, ftrl: Ftrl | None = None) -> Model | None:
    """Learn from text and non-null lang of rows whose crc32 of the id isn't divisible by ``every``; None without such rows.

    Document frequencies come from all of these rows, weights from a sample:
    of each language about SAMPLE_PER_LANGUAGE rows by hash of id and text
    (repeated rows once, and no more than twice as many over all languages).
    Of more than MOST_LANGUAGES languages those with the most rows are
    learned, ties by name; a single language is predicted for every text.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(_training(every))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return None
    # a share of each language's rows by hash, so that about SAMPLE_PER_LANGUAGE are chosen
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, SAMPLE_PER_LANGUAGE / n) * (1 << 40)))])
    key = F.xxhash64(F.lit(9), "doc_id", "text")
    chosen = F.coalesce(F.shiftrightunsigned(key, 24) < share[F.col("lang")], F.lit(False))
    bounded_batches(docs.sparkSession)
    learned = rows.select("text", "lang", chosen.alias("chosen"), key.alias("key")).mapInArrow(trimmed(_gather), _LEARN).persist()
    try:
        parts = learned.where("kind = 'df'").groupBy("part").applyInPandas(_sum_parts, "part int, docs long, n binary").collect()
        once = learned.where("kind = 'row'").dropDuplicates(["lang", "key"]).orderBy("key", "lang").limit(2 * SAMPLE_PER_LANGUAGE * len(sizes))
        sample = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in once.toLocalIterator())
    finally:
        learned.unpersist()
    df = np.concatenate([np.frombuffer(r["n"], "<i8") for r in sorted(parts, key=lambda r: r["part"])])
    idf = np.log((1.0 + parts[0]["docs"]) / (1.0 + df)) + 1.0
    languages = sorted(sizes)
    number = {x: k for k, x in enumerate(languages)}
    xs, ys = [], []
    for lang, at, n in sample:
        at = np.frombuffer(at, "<u2").astype(np.int64)
        x = np.frombuffer(n, "<u4") * idf[at]
        norm = np.sqrt((x * x).sum())
        # the last feature is constant
        xs.append((np.append(at, DIMS), np.append(x / norm if norm else x, 1.0)))
        ys.append(number[lang])
    ys = np.array(ys, np.int64)
    aside = np.random.default_rng(5).random(len(ys)) < 0.2
    w = (ftrl or Ftrl()).fit([x for x, a in zip(xs, aside, strict=True) if not a], ys[~aside], len(languages), DIMS + 1)
    held = [x @ w[at] for (at, x), a in zip(xs, aside, strict=True) if a]
    t = temperature(np.array(held).reshape(-1, len(languages)), ys[aside])
    return Model(languages, (w[:DIMS] * idf[:, None]).astype(np.float32), w[DIMS].astype(np.float32), (idf * idf).astype(np.float32), t)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred and score to (_row, doc_id, text): only the text is read for a prediction.

    ``und`` with score 0 is given to texts that are null or have no letter,
    and to all texts if there is no model.
    """
    trim()  # the sample that the model was learned from
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in pieces(batches, at):
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            held: list[int] = []
            block = np.zeros((CHUNK, DIMS), np.float32)

            def flush(names=names, scores=scores, held=held, block=block) -> None:
                for k, best, p in zip(held, *m.predict(block[: len(held)]), strict=True):
                    names[k], scores[k] = m.languages[best], float(p)
                held.clear()

            for k, x in enumerate(texts):
                text = x.decode("utf-8", "replace")
                if m is not None and has_letter(text):
                    block[len(held)] = counts(text)
                    held.append(k)
                    if len(held) == CHUNK:
                        flush()
            if held:
                flush()
            cols = [c for k, c in enumerate(batch.columns) if k != at] + [pa.array(names), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), schema)


def language_id(docs: DataFrame, every: int = 5) -> DataFrame:
    """Language of each document: doc_id, held_out, lang_pred, score.

    Learns as ``train`` says; lang, source and doc_id are never inputs of a
    prediction.  held_out is true if the id's crc32 is divisible by
    ``every`` and null for a null id, whose row isn't learned from.  Repeated
    rows have a result each; an empty table gives an empty result; other
    columns are not read.
    """
    model = train(docs, every)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc(F.col("doc_id")) % every == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model)
