"""Toxicity: restoration, held-out accuracy and defined cases."""

import os

import numpy as np
import pytest

from kinfold.llm import op8_noisy_channel_toxicity as op

DATA = "/root/testdata/sf0.1"
WORDS = "the quick idiot sat stupid near loser moron and trash with pathetic cats worthless dogs are no scum today".split()


def test_restores_disguised_words(spark):
    text = " ".join(WORDS * 50)
    cost = op.costs_of(op.count_trigrams(spark.createDataFrame([(text,), (None,)], "text string")))
    for disguised, word in [("1d1ot", "idiot"), ("5tup1d", "stupid"), ("stuuuupid", "stupid"), ("l0ser", "loser"), ("m.o.r.o.n", "moron"), ("tra$h", "trash"), ("p@thet1c", "pathetic"), ("5cum", "scum"), ("m*ron", "moron")]:
        assert op.restore(disguised, cost) == word
    read = op.Reader(cost)
    assert list(read.spaced("you i d i o t here".split())) == ["idiot"]
    plain = {b for w in ("idiot",) for b in read.features(w)}
    assert plain <= read.text("you 1d1ot!")[0] and plain <= read.text("i d i o t")[0]


def test_the_reader_decodes_heavy_disguises(spark):
    """Words of mostly digits and signs, with single separators or doubled letters, through the main path."""
    text = " ".join([*WORDS, "pass"] * 50)
    read = op.Reader(op.costs_of(op.count_trigrams(spark.createDataFrame([(text,)], "text string"))))
    for disguised, word in [("1d10t", "idiot"), ("p@55", "pass"), ("@$$", "ass"), ("l053r", "loser"), ("7r@5h", "trash"), ("w0r7h1355", "worthless"), ("p@7h371c", "pathetic"), ("s--t--u--p--i--d", "stupid"), ("iiddiioott", "idiot"), ("stuupid", "stupid")]:
        assert op._feature(word) in read.text(f"you {disguised} there")[0], disguised
    for plain in ("1337", "-3.50", "$1,200", "12:30", "2024-01-05", "10.0.0.1", "50%", "b0b@m411.example.com", "https://a.example/l053r", "www.l053r.example"):
        assert not op._disguised(plain)


def test_runs_of_letters_find_their_words(spark):
    sentences = ["you are an idiot", "the stupid moron sat near scum", "you idiot and your cats", "dogs are near the trash", "an owl sat today"]
    cost = op.costs_of(op.count_trigrams(spark.createDataFrame([(" . ".join(sentences * 50),)], "text string")))
    for words in ("you idiot", "you are an idiot", "the stupid moron sat near scum"):
        assert op.restore(words.replace(" ", ""), cost, True).split() == words.split()
    for words in ("you idiot", "the trash"):
        assert {op._feature(w) for w in words.split()} <= op.Reader(cost).text(" ".join(words.replace(" ", "")))[0]
    assert {op._feature(w) for w in ("moron", "idiot")} <= op.Reader(cost).text("moron-1d1ot")[0]


def test_long_runs_and_words_are_read_in_full(spark):
    text = " ".join([*WORDS, "you", "are"] * 50)
    cost = op.costs_of(op.count_trigrams(spark.createDataFrame([(text,)], "text string")))
    want = {op._feature("stupid"), op._feature("5^worth")}
    read = op.Reader(cost, frozenset(want))
    long = "the quick pathetic cats sat near the scum and the loser dogs are with no trash today you are stupid worthless moron"
    short = "you are stupid worthless"
    for s in (short, long):
        letters = s.replace(" ", "")
        assert read.text(" ".join(letters))[0] == want
        assert read.text(".".join(letters))[0] == want
        assert read.text(" ".join(letters.replace("stupid", "5tup1d")))[0] == want
    assert read.text("st" + "u" * 100 + "pid")[0] == {op._feature("stupid")}
    assert read.text("a plain astupid word")[0] == set()  # no place inside of plain words
    assert op.restore("1d" * 20_000, cost).count("d") == 20_000


def test_viterbi_is_the_best_path(spark):
    rng = np.random.default_rng(0)
    cost = op.costs_of(rng.random(op.ALPHABET**3))
    ids = op.letter_ids()

    def walk(options, a=0, b=0, made="", total=0.0):
        if not options:
            yield total + float(cost[a, b, 0]), made
            return
        for piece, extra in options[0]:
            x, y, t = a, b, total + extra
            for ch in piece:
                t += float(cost[x, y, int(ids[ord(ch)])])
                x, y = y, int(ids[ord(ch)])
            yield from walk(options[1:], x, y, made + piece, t)

    for word in ("1d10t", "aa1b", "l00000l", "p@55", "a*b", "x1!y"):
        assert op.restore(word, cost) == min(walk(op.lattice(word)))[1]


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_held_out_accuracy(spark):
    rows = op.query(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in hit]) > 0.85 and np.mean([r["predicted"] for r in clean]) < 0.01


def test_defined_cases(spark):
    rows = [(i, f"clean words number {i} here", 7) for i in range(60)] + [(100 + i, f"you idiot number {i}", 7) for i in range(60)]
    rows += [(300, None, 7), (301, "", 7), (None, "you idiot", 7), (302, "x " * 30_000, 7), (303, "you idiot", 7), (303, "you idiot", 7), (304, "1d1ot " + "9" * 5000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(r[0], int(100 <= (r[0] or 0) < 200), 1) for r in rows[:120]] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    model = op.train(docs, labels)
    got = op.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[303] > 0.5 > score[302] and score[300] == score[301] < 0.5
    nothing = op.train(docs, labels.limit(0))
    assert {r["score"] for r in op.score(docs, nothing).collect()} == {0.0}
    assert op.score(docs.limit(0), model).collect() == []
