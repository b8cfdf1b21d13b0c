"""BPE encoding and packing against the tokenizers library and brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinfold.llm import op6_minimum_bin_slack as packing
from kinfold.llm import op7_forced_boundary_bpe as bpe

TEXTS = [
    None, "", " ", "\n\n", "a", "Hello  world,\n\n it's we'll 123 4567!", "tab\tand\r\nline\x0b\x0c end ", "  lead", "trail  ", "naïve Ünï ß é ñ ö",
    "日本語 テスト 한국어", "é combining ̇I", "a\xa0b c d \x1cx\x1d\x1e y\x1f", "<|endoftext|> mid <|endoftext|><|startoftext|> x", "😀😃 👩‍👩‍👧 z", "ΟΔΟΣ ΣΑΣ İstanbul K",
    "x" * 3000, "ab" * 700 + "!?" * 300, "1234567890" * 40, "the the the " * 200, "don't DON'T 'S 's' ' 're", "﻿bom ​ zero", "line one.\nLine two.\n\nLine three.\n", "a \n b", "\t\t x", "\t  b",
]


def fuzz(n=300):
    rng = random.Random(7)
    alphabet = list("abcdeTHE,._\u03a3\u0130\u0301) 's  \n\n..!?019-_éßñ\t　\xa0日😀")
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 60))) for _ in range(n)]


def test_byte_bpe_equals_library():
    path = bpe.vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(path)
    for t in [*TEXTS, *fuzz()]:
        want = library.encode(t or "", add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries_hold_for_the_vocabulary():
    own = bpe.coder(bpe.vocabulary("byte_bpe_50k.json"))
    assert own.blank_cuts and own.stop_cuts
    assert not own.inside[ord("a") << 8 | ord(" ")] and own.inside[ord("t") << 8 | ord("h")]


def test_word_memo_equals_library():
    path = bpe.vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordMemo(path)
    rng = random.Random(8)  # marks that compose with the small letter, not with the capital
    marks = ["".join(rng.choices("JTHWYΪΫabjthwy \u030c\u0308\u0331\u030a\u0300\u0301.,", k=rng.randrange(1, 12))) for _ in range(4000)]
    for t in [*TEXTS, *fuzz(), "J\u030c", "T\u0308 W\u030a H\u0331 Y\u030a Ϊ\u0300", *marks]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def check_packed(rows, sequence):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= sequence
    return len(bins)


def test_plan_uses_up_every_histogram():
    rng = random.Random(3)
    for sequence in (5, 32, 100):
        for _ in range(40):
            histogram = dict(Counter(rng.randrange(1, sequence + 1) for _ in range(rng.randrange(0, 300))))
            patterns, used = packing.plan(histogram, sequence), Counter()
            for lengths, times in patterns:
                assert times > 0 and sum(x * n for x, n in lengths.items()) <= sequence
                used.update({x: n * times for x, n in lengths.items()})
            assert used == Counter(histogram)


def test_fullest_is_the_best_combination():
    rng = random.Random(5)
    for _ in range(60):
        items = [rng.randrange(1, 20) for _ in range(8)]
        counts = np.bincount(items, minlength=41)
        room = rng.randrange(1, 40)
        best = max(s for m in range(256) if (s := sum(x for i, x in enumerate(items) if m >> i & 1)) <= room)
        used = packing._fullest(counts, sorted(set(items), reverse=True), room)
        assert sum(x * n for x, n in used.items()) == best and all(n <= counts[x] for x, n in used.items())


@pytest.mark.parametrize("sequence", [16, 4096])
def test_pack_places_all_rows(spark, sequence):
    rng = random.Random(1)
    texts = [None, "", "one two", *[" ".join(rng.choices(["the", "cat", "sat", "xyzzy"], k=rng.randrange(0, 60))) for _ in range(120)], *["same text here"] * 40]
    docs = spark.createDataFrame([(i if i % 50 else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, length string").select("doc_id", "text")
    cut = packing.pieces(docs, bpe.vocabulary("word_bpe_49k.json"), sequence)
    rows = packing.pack(cut, sequence).collect()
    library = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    want = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    assert sum(r["length"] for r in rows) == sum(want) and len(rows) == sum(-(-n // sequence) for n in want)
    bins = check_packed(rows, sequence)
    assert bins <= -(-sum(want) // sequence) * 1.1 + 1


def test_pack_empty_table(spark):
    cut = packing.pieces(spark.createDataFrame([], "doc_id long, text string"), bpe.vocabulary("word_bpe_49k.json"))
    assert packing.pack(cut).collect() == []


def test_op7_query(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    path = bpe.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode_decode(docs, path).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
