"""Byte-level BPE by forced-boundary splitting.

A merge can only join two bytes that stand side by side inside some vocabulary
token. A byte pair that no token holds is therefore a certain cut. Texts are cut
in two steps:

1. before each blank or line feed, and before each full stop or comma after a
   letter or digit. No token holds such a pair (checked against the vocabulary
   when it is loaded), and the pre-tokenizer's pattern always starts a new match
   there, so the chunks between cuts are encoded independently and their ids
   concatenated. Ids of a chunk are kept in a bounded memo.
2. inside the pre-tokens of a new chunk, at every byte pair that no token holds.
   The fragments are merged independently, by the vocabulary's merge list, and
   concatenated.

Defined cases: null text is the empty text; an empty text has no ids. The
special token's own string in a text gets the special id, as the library does.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, held, table

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of the memo, per Python worker; a full memo is emptied.
CHUNKS = 700_000

#: White space other than blank and line feed: such texts take the plain path.
_OTHER_SPACE = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Where a cut before every blank, line feed, full stop and comma would not be certain.
_UNSURE = re.compile(r"[ \n]{2}|\W[.,]|_[.,]")
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


def _byte_names() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark task
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        vocab = spec["model"]["vocab"]
        merges = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in spec["model"]["merges"]]
        #: The merge list alone: no normalizer, no pre-tokenizer, no special tokens.
        self.fragments = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.stand_ins = {b: c for c, b in names.items()}
        self.token_bytes: dict[int, bytes] = {i: bytes(names[c] for c in t) for t, i in vocab.items()}
        self.inside = np.zeros(65536, bool)
        for raw in self.token_bytes.values():
            for a, b in zip(raw, raw[1:]):
                self.inside[a << 8 | b] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        # A no-break space ends in a byte that some tokens hold before a blank; texts with one take the plain path.
        tokens = [raw.replace(b"\xc2\xa0", b"") for raw in self.token_bytes.values()]
        self.blank_cuts = not any(re.search(rb"[^ \n][ \n]", raw) for raw in tokens)
        self.stop_cuts = not any(re.search(r"[^\W_][.,]", raw.decode("utf-8", "ignore")) for raw in tokens)
        self.memo: dict[str, bytes] = {"": b""}

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_split and any(s in text for s in self.special):
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.special_split.split(text) if p)
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; special tokens are kept."""
        get = self.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def _plain(self, text: str) -> bytes:
        if not self.blank_cuts or _OTHER_SPACE.search(text):
            keys = self.pattern.findall(text)
        elif not self.stop_cuts or _UNSURE.search(text):
            keys = _CHUNK.findall(text)
        else:
            keys = text.replace(" ", "\0 ").replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.").split("\0")
        found = list(map(self.memo.get, keys))
        if None in found:
            made = self._new({k for k, ids in zip(keys, found, strict=True) if ids is None})
            found = [made[k] if ids is None else ids for k, ids in zip(keys, found, strict=True)]
        return b"".join(found)

    def _new(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of chunks that the memo doesn't hold."""
        if len(self.memo) > CHUNKS:
            self.memo = {"": b""}
        words = {k: self.pattern.findall(k) for k in keys}
        unknown = list({w for parts in words.values() for w in parts if w not in self.memo})
        ids = dict(zip(unknown, self._pretokens(unknown), strict=True))
        for word, got in ids.items():
            if len(word) <= 64:
                self.memo[word] = got
        made = {}
        for key, parts in words.items():
            made[key] = got = ids[key] if key in ids else b"".join([ids[w] if w in ids else self.memo[w] for w in parts])
            if len(key) <= 64:
                self.memo[key] = got
        return made

    def _pretokens(self, words: list[str]) -> list[bytes]:
        """Cut pre-tokens at their forced boundaries and merge each fragment."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        joined = b"".join(raw)
        codes = np.frombuffer(joined, np.uint8).astype(np.int32)
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self.inside[codes[:-1] << 8 | codes[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        pieces = joined.decode("latin-1").translate(self.stand_ins)
        places = at.tolist()
        fragments = [pieces[a:b] for a, b in zip(places, places[1:])]
        merged = [np.array(e.ids, "<u4").tobytes() for e in self.fragments.encode_batch_fast(fragments, add_special_tokens=False)]
        last = np.searchsorted(at, ends).tolist()  # fragments up to each word's end
        return [merged[a] if b == a + 1 else b"".join(merged[a:b]) for a, b in zip([0, *last], last)]


def coder(path: str) -> ForcedBoundaryBPE:
    """One coder per Python worker."""
    return held(f"bytes/{path}", lambda: ForcedBoundaryBPE(path))


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids binary, decoded string)`` of every row of ``docs``.

    ``ids`` holds little-endian unsigned 32-bit token ids, ``decoded`` the text
    that those ids decode to. Null texts give empty ids and an empty text. Rows
    are independent: no shuffle, and a lost task is simply run again. ``path``
    must be readable on every executor (vocabularies are installed, not shipped).
    """
    kind = docs.schema[key].dataType

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for frame in frames:
            schema = pa.schema([frame.schema.field(0).with_name("key"), ("ids", pa.binary()), ("decoded", pa.string())])
            rows = ((k.as_py(), ids := bpe.encode(t.as_py()), bpe.decode(ids)) for k, t in zip(frame.column(0), frame.column(1), strict=True))
            yield from batches(rows, schema)

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind.simpleString()}, ids binary, decoded string")
    return out.withColumnRenamed("key", key)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
