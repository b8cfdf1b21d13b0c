"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 characters, letters in lower case,
everything else one blank) with TF-IDF weights; document frequencies are counted
over every learnable document. The weights are trained with
follow-the-regularised-leader under an elastic net (L1 makes them sparse, L2
keeps them small) on a sample of at most ``TRAIN_ROWS`` labelled documents, and a
temperature fitted on documents left out of the training calibrates the scores.

Learnable documents are those whose crc32(doc_id) modulo 4 is known and not 2
and whose ``lang`` and ``text`` are not null. ``lang``, ``source`` and ``doc_id``
are no inputs of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with
no learnable document every text is ``und``; one language only gives that
language. Every row gives one row; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dense, remainder, sums, table

#: Hash buckets of n-grams.
SIZE = 1 << 15
#: Bound of the labelled sample that the weights are fitted on, all languages together.
TRAIN_ROWS = 2400
#: Share of the sample that is kept for the temperature.
CALIBRATION = 0.2

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: its lower-case letter's code point, or 32."""
    global _LETTERS
    if _LETTERS is None:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTERS = out
    return _LETTERS


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a text's n-grams; None where it has no letter."""
    if not text:
        return None
    codes = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)  # runs of blanks count once
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    if len(codes) < 3 and not (codes != 32).any():
        return None
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    counts = np.bincount(np.concatenate([one, two, three]) >> np.uint32(17), minlength=SIZE)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha=2.0, beta=1.0, l1=0.002, l2=0.001, epochs=4, seed=1) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates and an elastic net.

    ``rows`` holds (buckets, values, class). Returns weights (SIZE, classes).
    """
    z, n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))

    def weights(at):
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def fit_temperature(scores: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of least log loss, by golden-section search on its log."""
    if not scores:
        return 1.0
    s, y = np.array([a for a, _ in scores]), np.array([b for _, b in scores])

    def loss(t):
        z = s / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    a, b, r = np.log(0.02), np.log(10), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model of ``docs``: languages, idf, weights and temperature.

    Frequencies come from every learnable document; the sample has at most
    ``train_rows`` of them, the same number for each language as far as there are.
    """
    known = docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(frames: Iterator[pd.DataFrame]):
        total = np.zeros(SIZE + 1)
        for f in frames:
            for text in f["text"]:
                if got := grams(text):
                    total[got[0]] += 1
                    total[SIZE] += 1
        at = np.flatnonzero(total)
        yield at, total[at]

    df = dense(sums(known.select("text"), frequencies), SIZE + 1)
    idf = (np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1).astype(np.float32)

    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "idf": idf, "weights": np.zeros((SIZE, 0), np.float32), "temperature": 1.0}
    share = max(1, train_rows // len(langs))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    # A thinned candidate set first, so that the rank below sorts a bounded number of rows.
    chance = F.lit(0)
    for lang in langs:
        chance = F.when(F.col("lang") == lang, F.lit(int(min(1.0, (2 * share + 50) / sizes[lang]) * 1_000_000))).otherwise(chance)
    ranked = known.where(spread < chance).select("doc_id", "lang", spread.alias("_spread")).dropDuplicates(["doc_id", "lang"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_spread", "doc_id"))
    chosen = ranked.withColumn("_rank", rank).where(F.col("_rank") <= share).select("doc_id").distinct()
    picks = [r["doc_id"] for r in chosen.collect()]  # at most train_rows ids

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, text, lang in zip(f["doc_id"], f["text"], f["lang"], strict=True):
                if got := grams(text):
                    out.append((str(key), lang, got[0].astype("<u2").tobytes(), got[1].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["key", "lang", "at", "counts"])

    sample = known.where(F.col("doc_id").isin(picks)).select("doc_id", "text", "lang").mapInPandas(features, "key string, lang string, at binary, counts binary").dropDuplicates(["key", "lang"])
    got = sorted(sample.toLocalIterator(), key=lambda r: (r["key"], r["lang"], r["at"]))
    rows = []
    for r in got:
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        rows.append((at, weighed(at, np.frombuffer(r["counts"], "<u4").astype(np.float32), idf), langs.index(r["lang"])))
    held = np.random.default_rng(2).random(len(rows)) < CALIBRATION
    weights = fit_ftrl([r for r, h in zip(rows, held, strict=True) if not h], len(langs))
    temperature = fit_temperature([(x @ weights[at], y) for (at, x, y), h in zip(rows, held, strict=True) if h])
    return {"langs": langs, "idf": idf, "weights": weights.astype(np.float32), "temperature": temperature}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row; the model is a bounded table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    langs, idf, weights, temperature = model["langs"], model["idf"], model["weights"], model["temperature"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            names, scores = [], []
            for cell in frame.column(1):
                got = grams(cell.as_py()) if langs else None
                if got is None:
                    names.append("und")
                    scores.append(0.0)
                else:
                    p = softmax(weighed(*got, idf) @ weights[got[0]] / temperature)
                    best = int(p.argmax())
                    names.append(langs[best])
                    scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
