"""Quality classifier by co-training over two views of a document.

* The content view sees the characters and words of the text: shares of letter
  kinds and signs, repetition of words, word lengths, frequent words.
* The metadata view sees the page as a record: source, language, stated size, and
  the layout of its lines, never what stands in them. The record's fields alone
  say nothing of quality in the tables at hand, so nothing could be exchanged.

Labelled rows start both classifiers. In each round the unlabelled documents that
one view is surest of, in either class, become pseudo-labelled rows of the *other*
view (by quantiles of its log odds over all of them, so ties go together and views
that tell nothing apart pass nothing on); both are fitted again, by Newton steps whose sums run over all rows on the
executors. At last each view is calibrated on labelled rows that took no part in
the fitting (by a line through its log odds), and a logistic regression of the two
calibrated log odds, on the same rows, combines them. Where those rows are of one
class, calibration and combination use all labelled rows.

Both feature tables are computed once from the whole texts and stored; texts are
never shuffled.

Defined cases: null and empty texts have zero features and score like any row;
labels that are null, or whose document is missing, are not used; with labels of
one class only every score is that class (0.5 without labels). Every row gives
one row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fit_logistic, keep_rows, stored, table

#: Rounds of exchanging pseudo-labels.
ROUNDS = 2
#: A view passes on the labels of so large a share of what either class has by its
#: share among the labels: the unlabelled rows that it is surest of.
CONFIDENT = 0.1
#: Weight of a pseudo-labelled row beside a labelled one.
PSEUDO = 0.2
#: Labelled rows in 1 of so many folds are kept for calibration.
FOLDS = 4
#: Hashed cells of the source and the language.
SOURCES, LANGS = 8, 4

_KINDS: np.ndarray | None = None
SIGNS = "!?.,;:|#$%&*@<>{}[]()=+/\\_~^-\"'"


def _kinds() -> np.ndarray:
    """Kind of each code point: 0 blank, 1 line feed, 2 lower, 3 upper, 4 other
    letter, 5 digit, 6 other, 7 and on the signs."""
    global _KINDS
    if _KINDS is None:
        out = np.full(0x110000, 6, np.uint8)
        for c in range(0x30000):
            ch = chr(c)
            out[c] = 2 if ch.islower() else 3 if ch.isupper() else 4 if ch.isalpha() else 5 if ch.isdigit() else 0 if ch.isspace() else 6
        out[10] = 1
        for i, ch in enumerate(SIGNS):
            out[ord(ch)] = 7 + i
        _KINDS = out
    return _KINDS


N_KINDS = 7 + len(SIGNS)
CONTENT = 1 + 5 + len(SIGNS) + 12
METADATA = 1 + SOURCES + LANGS + 8


def content_view(text: str) -> np.ndarray:
    """Features of characters and words; all within a few units of 0."""
    out = np.zeros(CONTENT, np.float32)
    out[0] = 1
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[codes]
    shares = np.bincount(kinds, minlength=N_KINDS) / len(codes)
    out[1 : 1 + 5] = shares[[2, 3, 4, 5, 6]]
    out[6 : 6 + len(SIGNS)] = np.minimum(shares[7:] * 20, 3)
    words = text.split()
    at = 6 + len(SIGNS)
    if words:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int32, n)
        distinct = set(words)
        same = sum(map(str.__eq__, words, words[1:]))
        most = max(Counter(words).values()) / n
        ends = sum(not w[-1].isalnum() for w in words) / n
        starts = sum(w[0].isupper() for w in words) / n
        out[at : at + 12] = [
            min(lengths.mean() / 10, 3),
            min(lengths.std() / 10, 3),
            min(lengths.max() / 100, 3),
            same / n,
            len(distinct) / n,
            len(distinct) / n**0.8,
            most,
            ends,
            starts,
            (lengths <= 3).mean(),
            (lengths == 1).mean(),
            np.log1p(n) / 10,
        ]
    return out


def metadata_view(text: str, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Features of the page record and of the outline of its lines."""
    out = np.zeros(METADATA, np.float32)
    out[0] = 1
    out[1 + _cell(source, SOURCES)] = 1
    out[1 + SOURCES + _cell(lang, LANGS)] = 1
    lines = text.split("\n") if text else []
    lengths = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    size = len(text) if n_chars is None else n_chars
    out[1 + SOURCES + LANGS :] = [
        np.log1p(max(0, size)) / 10,
        np.log1p(len(lines)) / 10,
        np.log1p(lengths.mean()) / 10,
        np.log1p(lengths.std()) / 10,
        np.log1p(lengths.max()) / 10,
        (lengths < 20).mean(),
        len(set(lines)) / max(1, len(lines)),
        float(abs(size - len(text)) > 0),
    ]
    return out


def _cell(name: str | None, cells: int) -> int:
    return zlib.crc32((name or "").encode("utf-8", "surrogatepass")) % cells


def views(docs: DataFrame) -> DataFrame:
    """``(doc_id, content, metadata)`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            content, meta = [], []
            for t, s, g, n in zip(*(f.column(i).to_pylist() for i in range(1, 5)), strict=True):
                t = t or ""
                content.append(content_view(t))
                meta.append(metadata_view(t, s, g, n))
            arrays = [pa.array(x, pa.list_(pa.float32())) for x in (content, meta)]
            yield pa.RecordBatch.from_arrays([f.column(0), *arrays], names=["doc_id", "content", "metadata"])

    columns = [F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return docs.select("doc_id", *columns).mapInArrow(run, f"doc_id {kind}, content array<float>, metadata array<float>")


def _odds(column: str, w: np.ndarray) -> F.Column:
    """Log odds of a view as a column expression."""
    weights = F.array(*[F.lit(float(x)) for x in w])
    return F.aggregate(F.zip_with(F.col(column), weights, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)


def train(table_of_views: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> dict:
    """The co-trained model of stored ``views`` and ``labels``."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("_label"))
    rows = stored(table_of_views.join(known, F.col("doc_id") == F.col("_id"), "left").select("content", "metadata", "_label", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(FOLDS)).alias("_fold")))
    sizes = {r["_label"]: r["n"] for r in rows.where("_label is not null").groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {"constant": float(next(iter(sizes), 0.5))}
    learned = (F.col("_label").isNotNull()) & (F.col("_fold") != 0)
    w = {}
    for view, size in (("content", CONTENT), ("metadata", METADATA)):
        w[view] = fit_logistic(rows.where(learned).select(view, "_label", F.lit(1.0).alias("_w")), view, "_label", "_w", size, l2=1.0, rounds=8)
    good = sizes.get(1, 0) / sum(sizes.values())
    for _ in range(rounds):
        before = dict(w)
        for view, other, size in (("content", "metadata", CONTENT), ("metadata", "content", METADATA)):
            says = _odds(other, before[other])
            open_ = rows.where("_label is null").select(F.percentile_approx(says, F.array(F.lit((1 - good) * confident), F.lit(1 - good * confident)), 10_000).alias("q")).first()["q"]
            low, high = open_ if open_ and open_[0] < open_[1] else (-np.inf, np.inf)
            given = F.when(learned, F.col("_label")).when(F.col("_label").isNull() & (says >= float(high)), 1).when(F.col("_label").isNull() & (says <= float(low)), 0)
            fed = rows.select(view, given.alias("_y"), F.when(learned, F.lit(1.0)).otherwise(F.lit(PSEUDO)).alias("_w")).where("_y is not null")
            w[view] = fit_logistic(fed, view, "_y", "_w", size, l2=1.0, rounds=3, start=before[view])
    held = rows.where(F.col("_label").isNotNull() & (F.col("_fold") == 0))
    if held.select("_label").distinct().count() < 2:
        held = rows.where("_label is not null")
    out: dict = dict(w)
    for view in ("content", "metadata"):
        one = held.select(F.array(F.lit(1.0), _odds(view, w[view]) / 4).alias("x"), F.col("_label").alias("y"), F.lit(1.0).alias("w"))
        out[f"{view}_line"] = fit_logistic(one, "x", "y", "w", 2, l2=0.1, rounds=10)
    both = held.select(F.array(F.lit(1.0), *[_calibrated(view, out) / 4 for view in ("content", "metadata")]).alias("x"), F.col("_label").alias("y"), F.lit(1.0).alias("w"))
    return out | {"combine": fit_logistic(both, "x", "y", "w", 3, l2=0.1, rounds=10)}


def _calibrated(view: str, model: dict) -> F.Column:
    """The calibrated log odds of a view."""
    a, b = model[f"{view}_line"]
    return F.lit(float(a)) + _odds(view, model[view]) / 4 * float(b)


def score(table_of_views: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score, keep)``: the probability of good quality, and whether
    it is at least one half."""
    if "constant" in model:
        p = F.lit(model["constant"])
    else:
        c = model["combine"]
        z = F.lit(float(c[0])) + _calibrated("content", model) / 4 * float(c[1]) + _calibrated("metadata", model) / 4 * float(c[2])
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return table_of_views.select("doc_id", p.alias("score")).withColumn("keep", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that the model keeps, with all their columns, whatever their
    names; null texts are judged as empty ones, repeated rows alike, and an empty
    table gives an empty table."""

    def judge():
        def decide(f: pa.RecordBatch) -> list[bool]:
            if "constant" in model:
                return [model["constant"] >= 0.5] * f.num_rows
            given = [f.column(c).to_pylist() if c in f.schema.names else [None] * f.num_rows for c in ("text", "source", "lang", "n_chars")]
            c, (a0, a1), (b0, b1) = model["combine"], model["content_line"], model["metadata_line"]
            out = []
            for t, s, g, n in zip(*given, strict=True):
                z = c[0] + (a0 + content_view(t or "") @ model["content"] / 4 * a1) / 4 * c[1] + (b0 + metadata_view(t or "", s, g, n) @ model["metadata"] / 4 * b1) / 4 * c[2]
                out.append(bool(z >= 0))
            return out

        return decide

    return keep_rows(docs, judge)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score, keep)`` of every row of ``docs``, co-trained on them."""
    seen = stored(views(docs))
    return score(seen, train(seen, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
