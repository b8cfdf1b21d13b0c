"""Personal data: plain spans against the contract's own patterns, and mapping."""

import random
import re

import pytest

from kinfold.llm import op10_pii as op


def base(text):
    text = text or ""
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(digits) <= 19 and op.luhn(digits), 9 <= len(digits) <= 15][k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_plain_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", ".", "example", "com", "-", "1", "4", "255", "256", "192.168.0.1", "4111 1111 1111 1111", "+1 (415) 555-2671", "+", " ", "é", "😀", "\n", "4111-1111-1111-1111", "_%", "00", "(", ")", "[at]"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(25)))
        assert [x[:3] for x in op.find_spans(text) if x[3]] == base(text), text


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail joe [at] example [dot] org now", "email", "joe [at] example [dot] org"),
        ("mail joe(at)example(dot)org", "email", "joe(at)example(dot)org"),
        ("write joe at example dot org please", "email", "joe at example dot org"),
        ("ｊoe@exаmple.org", "email", "ｊoe@exаmple.org"),
        ("call +four one five five five five two six seven one ok", "phone", "+four one five five five five two six seven one"),
        ("call plus four one five five five five two six seven one ok", "phone", "plus four one five five five five two six seven one"),
        ("ip １９２.１６８.０.１ end", "ip", "１９２.１６８.０.１"),
        ("card 4111​111111111111 end", "card", "4111​111111111111"),
        ("mail joe@example[.]com now", "email", "joe@example[.]com"),
        ("at 10[.]0[.]0[.]1 now", "ip", "10[.]0[.]0[.]1"),
        ("ip ten dot zero dot zero dot one end", "ip", "ten dot zero dot zero dot one"),
        ("ip one nine two dot one six eight dot zero dot one.", "ip", "one nine two dot one six eight dot zero dot one"),
        ("mail joe_at_example_dot_com now", "email", "joe_at_example_dot_com"),
        ("call plus four four double two seven triple five one nine ok", "phone", "plus four four double two seven triple five one nine"),
        ("é j o e @ e x a m p l e . c o m there", "email", "j o e @ e x a m p l e . c o m"),
        ("😀 joe&#64;example&period;com!", "email", "joe&#64;example&period;com"),
        ("😀😀 ana [at] mail.example.org 😀", "email", "ana [at] mail.example.org"),
    ],
)
def test_disguises_map_back_to_their_source(text, kind, source):
    found = [(op.KINDS[k], text[a:b]) for k, a, b, plain in op.find_spans(text) if not plain]
    assert (kind, source) in found, found


def test_clean_text_adds_nothing():
    for text in ("look at example.com", "ten dots, one dot zero", "a_dot_b at_home", "a @ b . c", "We met at noon and dot the line.", "one two", "look at the dot", "a@b", "+12", "1.2.3", "x" * 100_000, "1" * 100_000, "a@" * 20_000, ("+1" + " " * 500) * 50, "one two three " * 2000):
        assert [x for x in op.find_spans(text) if x[0] == 0] == [] or text.startswith("a@b")


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (None, "joe@example.org", "k"), (3, "", "k"), (3, "", "k")], "doc_id long, text string, found string")
    rows = sorted(op.digest(op.find_pii(docs)).collect(), key=lambda r: (r["doc_id"] or 0))
    assert [r["n_email"] for r in rows] == [1, 0, 0, 0] and rows[0]["spans"] == "email:0:15"
    assert op.digest(op.find_pii(docs.limit(0))).collect() == []
