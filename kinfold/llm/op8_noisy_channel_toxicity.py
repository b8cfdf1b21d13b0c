"""Toxicity with noisy-channel deobfuscation.

1. A character language model: trigram counts over the letters of all texts,
   gathered from every document (the counts grow with the corpus, the table of
   ``ALPHABET ** 3`` cells does not).
2. Words that may be disguised (digits or signs in them, letters doubled or
   repeated, single letters set apart by blanks or dots; all but plain numbers,
   e-mail addresses and URLs) become a lattice of characters they may stand for;
   Viterbi search under the language model and the channel's costs restores the
   word.
3. Restored words and their prefixes are looked up in a lexicon of log odds
   learned from labelled texts, and a logistic regression over what the lexicon
   finds gives the score. Where blanks or dots between all letters hide the ends
   of words, and in words over LONG, the lexicon is looked up at every place.

Labels are learned only from rows whose crc32(doc_id) modulo 5 is known and not
0, at most TRAIN_ROWS of them, a hash of the text deciding whether a row serves the lexicon or the
regression, so that the regression sees honest lexicon hits. Labels, lang, source
and doc_id are no inputs of a score.

Defined cases: a null or empty text has no hits and gets the score of such texts;
without labelled rows of both classes every score is the share of toxic labels
(0 without any). Every row gives one row; whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense, fit_logistic, held, keep_rows, remainder, stored, sums, table

#: Letters of the language model: boundary, a-z, and classes of other letters.
ALPHABET = 40
#: A lexicon entry must stand in so many toxic texts, in this share of them, and
#: have log odds of this much; rarer features tell copies apart, not tone.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 5, 0.008, 4.0
#: Bound of the sample of labelled rows that lexicon and regression are fitted on.
TRAIN_ROWS = 20_000
#: Prefix lengths that stand beside whole words.
PREFIXES = (4, 5, 6)
#: Entries of the word memo, per Python worker.
WORDS = 500_000
#: Words over this length are read anew each time; the memo holds shorter ones.
LONG = 64

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "%": "o", "#": "h", "&": "a",
}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Costs of the channel, in nats.
SUBSTITUTE, COLLAPSE, KEEP_REPEAT, DROP, WILD, SPLIT = 1.0, 0.3, 3.0, 7.0, 4.0, 0.5

_TABLE: np.ndarray | None = None


def letter_ids() -> np.ndarray:
    """Letter number of each code point: 0 for anything that is no letter."""
    global _TABLE
    if _TABLE is None:
        out = np.zeros(0x110000, np.uint16)
        for c in range(0x30000):
            ch = chr(c).lower()
            if ch[0].isalpha():
                low = ord(ch[0])
                out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (ALPHABET - 27)
        _TABLE = out
    return _TABLE


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts: one cell for each three letters."""

    def partial(frames: Iterator[pd.DataFrame]):
        total = np.zeros(ALPHABET**3)
        for f in frames:
            for t in f["t"]:
                if t:
                    ids = letter_ids()[np.frombuffer(f"  {t} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
                    total += np.bincount((ids[:-2] * ALPHABET + ids[1:-1]) * ALPHABET + ids[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield at, total[at]

    return dense(sums(docs.select(F.col(text).alias("t")), partial), ALPHABET**3)


def costs_of(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of the third letter after two, interpolated."""
    cube = counts.reshape(ALPHABET, ALPHABET, ALPHABET) + 1e-9
    two = cube.sum(0)
    one = two.sum(0)
    p3 = cube / cube.sum(2, keepdims=True)
    p2 = two / two.sum(1, keepdims=True)
    p1 = (one + 1) / (one + 1).sum()
    return -np.log(0.7 * p3 + 0.2 * p2[None] + 0.1 * p1[None, None]).astype(np.float32)


def lattice(word: str, run: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of equal characters: the strings it may stand for, with
    the channel's cost. A separator may be the end of a word; where letters stood
    apart (``run``), so may every place between two of them."""
    out = []
    i = 0
    while i < len(word):
        j = i
        while j < len(word) and word[j] == word[i]:
            j += 1
        c, n = word[i], j - i
        if c.isalpha():
            options = [(c, 0.0 if n == 1 else COLLAPSE if n > 2 else KEEP_REPEAT), *([(c + c, 0.0 if n == 2 else COLLAPSE + 0.5)] if n > 1 else [])]
            if run and n > 1:
                options.append((f"{c} {c}", SPLIT + (COLLAPSE + 0.5) * (n > 2)))
        elif c in LEET:
            options = [(o * min(k, 2), SUBSTITUTE) for o in LEET[c] for k in {1, n}]
            options.append(("", DROP * n))
        elif c == "*":
            options = [(o, WILD) for o in _LETTERS] if n == 1 else [("", DROP)]
        else:
            options = [("", 0.1), (" ", SPLIT)]  # a separator
        if run and out:
            out.append([("", 0.0), (" ", SPLIT)])
        out.append(options)
        i = j
    return out


def restore(word: str, cost: np.ndarray, run: bool = False) -> str:
    """The likeliest word or words behind ``word``, blanks between them: Viterbi
    search over its lattice. Paths share what they have in common, so the cost is
    linear in the length."""
    ids = letter_ids()
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(word, run):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (total, made) in states.items():
            for piece, extra in options:
                x, y, sum_ = a, b, total + extra
                for ch in piece:
                    k = int(ids[ord(ch)])
                    sum_ += float(cost[x, y, k])
                    x, y = y, k
                if (x, y) not in after or sum_ < after[x, y][0]:
                    after[x, y] = (sum_, (made, piece) if piece else made)
        states = after
    ends = [(total + float(cost[a, b, 0]), made) for (a, b), (total, made) in states.items()]
    least = min(total for total, _ in ends)
    return min(_joined(made) for total, made in ends if total == least)


def _joined(made: tuple) -> str:
    pieces = []
    while made:
        made, piece = made
        pieces.append(piece)
    return "".join(reversed(pieces))


def _feature(s: str) -> int:
    """A hash whose last byte is the length (255: that or more)."""
    return xxhash.xxh64_intdigest(s) >> 9 << 8 | min(len(s), 255)


class Reader:
    """Lexicon features of texts, with disguises undone."""

    def __init__(self, cost: np.ndarray, only: frozenset[int] | None = None):
        self.cost = cost
        self.only = only  # features that matter; None: all
        self.lengths = sorted({k & 255 for k in only or () if 3 <= k & 255 < 255})
        self.memo: dict[tuple[str, bool], tuple[int, ...]] = {}

    def features(self, word: str, run: bool = False) -> tuple[int, ...]:
        """Hashes of a white-space word: itself, its prefixes, and the same for
        what it is restored to. ``run``: its letters were words of their own."""
        known = self.memo.get((word, run))
        if known is None:
            if len(self.memo) > WORDS:
                self.memo.clear()
            core = word.strip(".,;:?\"'()[]{}<>…¡¿«»“”‘’")
            forms = {core.strip("!*_-~")}
            if len(core) >= 2 and _disguised(core):
                restored = restore(core, self.cost).split()
                forms.update(restored, ["".join(restored)])
            if run:
                forms.update(restore(core, self.cost, True).split())
            made = {_feature(f) for f in forms if f} | {_feature(f"{p}^{f[:p]}") for f in forms for p in PREFIXES if len(f) >= p}
            if self.only is not None:
                made &= self.only
                if self.only and (run or len(core) > LONG or _set_apart(core)):
                    made.update(k for f in forms for k in self.inside(f))
            known = tuple(made)
            if len(word) <= LONG:
                self.memo[word, run] = known
        return known

    def inside(self, form: str) -> Iterator[int]:
        """The features that matter at every place of ``form``: words of three
        letters and more, and prefixes."""
        only = self.only or ()
        for i in range(len(form) - 2):
            for n in self.lengths:
                if i + n <= len(form) and (k := _feature(form[i : i + n])) in only:
                    yield k
            for p in PREFIXES:
                if i + p <= len(form) and (k := _feature(f"{p}^{form[i : i + p]}")) in only:
                    yield k

    def text(self, text: str | None) -> tuple[set[int], int]:
        """Distinct features and the number of words."""
        words = (text or "").lower().split()
        found: set[int] = set()
        features = self.features
        for w in set(words):
            found.update(features(w))
        for w in self.spaced(words):
            found.update(features(w, True))
        return found, len(words)

    def spaced(self, words: list[str]) -> Iterator[str]:
        """Words whose letters are set apart: runs of at least three one-letter
        words, restored as one."""
        if not words:
            return
        single = bytes(map((1).__eq__, map(len, words)))
        at = single.find(b"\1\1\1")
        while at >= 0:
            end = single.find(b"\0", at)
            end = len(single) if end < 0 else end
            yield "".join(words[at:end])
            at = single.find(b"\1\1\1", end)


#: Numbers with signs, units of money, dates and times; e-mail addresses; URLs.
_PLAIN = re.compile(
    r"[+\-±~#$€£¥]*\d[\d.,:/+\-]*[%$€£¥]?"
    r"|[\w.+%-]+@(?:[\w-]+\.)+[a-z]{2,}"
    r"|(?:https?|ftps?|sftp|wss?|file|ssh|git|s3)://\S+|mailto:\S+|www\.(?:[\w-]+\.)+\S+"
)
_DOUBLED = re.compile(r"(.)\1")


def _disguised(word: str) -> bool:
    """Whether a word may stand for another: it has a sign that stands for a
    letter, or letters that are doubled or set apart, and is no plain number,
    address or URL."""
    if word.isalpha():
        return _DOUBLED.search(word) is not None
    return any(c.isalpha() or c in LEET for c in word) and _PLAIN.fullmatch(word) is None


def _set_apart(word: str) -> bool:
    """Whether signs that stand for no letter part the word into mostly single characters."""
    if word.isalnum():
        return False
    parts = "".join(c if c.isalpha() or c in LEET or c == "*" else " " for c in word).split()
    single = sum(len(p) == 1 for p in parts)
    return single >= 3 and single * 2 >= len(parts)


def reader(key: str, cost: np.ndarray, only: frozenset[int] | None = None) -> Reader:
    """One reader per Python worker, for a language model and set of features."""
    return held(f"reader/{key}", lambda: Reader(cost, only))


#: Inputs of the regression.
SIZE = 6


def inputs(found: set[int], words: int, lexicon: dict[int, float]) -> np.ndarray:
    hits = [lexicon[h] for h in found if h in lexicon]
    total, most = sum(hits), max(hits, default=0.0)
    return np.array([1.0, most, np.log1p(total), np.log1p(len(hits)), total / (words + 20), np.log1p(words) / 10])


def _counts(rows: DataFrame, key: str, cost: np.ndarray, wanted: frozenset[int] | None, least: float) -> dict[int, np.ndarray]:
    """In how many texts of each fold a feature stands, for features in at least
    ``least`` texts, or for those ``wanted``. Partial counts go by feature; only
    what passes comes to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader(f"{key}/{0 if wanted is None else hash(wanted)}", cost, wanted)
        for f in frames:
            held: tuple[list[int], list[int]] = ([], [])
            for t, fold in zip(f["text"], f["fold"], strict=True):
                held[int(fold)].extend(read.text(t)[0])
            for fold in (0, 1):
                features, n = np.unique(np.array(held[fold], np.int64), return_counts=True)
                yield pd.DataFrame({"k": features, "n0": n * (fold == 0), "n1": n * (fold == 1)})

    found = rows.select("text", "fold").mapInPandas(run, "k long, n0 long, n1 long").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least).toPandas()
    return {int(k): np.array([a, b]) for k, a, b in found.itertuples(index=False)}


def learn_lexicons(rows: DataFrame, key: str, cost: np.ndarray) -> tuple[dict[int, float], dict[int, float]]:
    """Log odds of the features that tell toxic texts: from fold 0, and from all.

    ``rows`` has ``text``, ``toxic`` and ``fold``, one row per distinct text. The
    first pass counts the features of toxic texts; only those that enough toxic
    texts share are counted in all others. At most 1 / LEAST_SHARE times the
    features of a toxic text can pass. What passes is then counted again in the
    toxic texts, now at every place a reader looks it up.
    """
    sizes = np.zeros((2, 2))
    for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect():
        sizes[r["toxic"], r["fold"]] = r["n"]
    least = max(LEAST_TEXTS, LEAST_SHARE * sizes[1].sum())
    toxic = _counts(rows.where("toxic = 1"), key, cost, None, least / 2)
    wanted = frozenset(toxic)
    toxic = _counts(rows.where("toxic = 1"), key, cost, wanted, 0)
    clean = _counts(rows.where("toxic = 0"), key, cost, wanted, 0)

    def odds(folds: list[int]) -> dict[int, float]:
        out = {}
        n_toxic, n_clean = sizes[1, folds].sum(), sizes[0, folds].sum()
        for k, n in toxic.items():
            t, c = n[folds].sum(), clean.get(k, np.zeros(2))[folds].sum()
            score = float(np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)))
            if t >= least * len(folds) / 2 and score >= LEAST_ODDS:
                out[k] = score
        return out

    return odds([0]), odds([0, 1])


def _labelled(docs: DataFrame, toxic: dict) -> DataFrame:
    """``(text, toxic)`` of the rows whose id is in ``toxic``: the bounded sample
    of labels goes to the texts, so no text is shuffled for it."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            found = [toxic.get(k) for k in f.column(0).to_pylist()]
            keep = pa.array([k is not None for k in found])
            part = f.filter(keep)
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([k for k in found if k is not None], pa.int32())], names=["text", "toxic"])

    return docs.where(remainder("doc_id", 5) != 0).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "text string, toxic int")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model: language model of all ``docs``, lexicon and regression of a
    sample of at most ``train_rows`` labels that may be learned from."""
    counts = count_trigrams(docs)
    cost = costs_of(counts)
    key = xxhash.xxh64_hexdigest(cost.tobytes())
    known = labels.where((remainder("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Thinned by a hash first: what is collected is bounded, and no task sorts all labels.
    chance = min(1.0, 1.1 * train_rows / max(1, known.count()))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000))
    sample = known.where(spread < int(chance * 1_000_000) + 1).select("doc_id", "toxic", spread.alias("spread")).collect()
    sample = sorted(sample, key=lambda r: (r["spread"], r["doc_id"]))[:train_rows]
    rows = _labelled(docs, {r["doc_id"]: r["toxic"] for r in sample})
    # One row per distinct text: copies teach nothing new. A text with both labels counts as toxic.
    rows = rows.groupBy(F.xxhash64("text").alias("fold")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = stored(rows.select("text", "toxic", F.pmod("fold", F.lit(2)).alias("fold")))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return {"cost": cost, "key": key, "lexicon": {}, "w": None, "share": float(share)}
    honest, lexicon = learn_lexicons(rows, key, cost)

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader(f"{key}/fold", cost, frozenset(honest))
        for f in frames:
            yield pd.DataFrame({"x": [inputs(*read.text(t), honest) for t in f["text"]], "y": f["toxic"].astype(float), "w": 1.0})

    seen = stored(rows.where("fold = 1").select("text", "toxic").mapInPandas(vectors, "x array<double>, y double, w double"))
    w = fit_logistic(seen, "x", "y", "w", SIZE, l2=0.5, rounds=10)
    # The lexicon that scores is learned from all learnable rows.
    return {"cost": cost, "key": key, "lexicon": lexicon, "w": w, "share": float(share)}


def _scorer(model: dict):
    """A function from a text to its score, for one task."""
    cost, key, lexicon, w, share = model["cost"], model["key"], model["lexicon"], model["w"], model["share"]
    if w is None:
        return lambda text: share
    read = reader(f"{key}/score", cost, frozenset(lexicon))

    def score_of(text: str | None) -> float:
        z = float(inputs(*read.text(text), lexicon) @ w)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score_of


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model)
        for f in frames:
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array([of(t.as_py()) for t in f.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that score below 0.5, with all their columns."""

    def judge():
        of = _scorer(model)
        return lambda f: [of(t.as_py()) < 0.5 for t in f.column("text")]

    return keep_rows(docs, judge)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
