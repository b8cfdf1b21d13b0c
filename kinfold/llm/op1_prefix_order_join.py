"""N-gram Jaccard join by prefix filters under several token orders.

A document's set holds the 63-bit hashes of its distinct word shingles; equal
sets are one class, by a 63-bit hash of the set. Beyond clashes of these hashes
the join is exact. For a pair to reach the threshold, its sets must share tokens
in their prefixes under *every* order of the tokens, so the orders' filters are
intersected before any pair is verified:

1. by hash: only a class's lowest hashes take part (the l-prefix: a linked pair
   shares at least l of them);
2. by frequency among those, rarest first: of the l-prefix, only its rarest
   tokens are posted, so passages that many documents share fall away and a
   class whose rare tokens stand nowhere else is finished;
3. by a second hash: a candidate pair must also share a token of the l-prefix's
   first tokens in this order.

Pairs within a posting list are never listed. Components grow in rounds:

* hubs: every class of a list is compared with one hub of it, so a group of
  thousands of near copies costs about one comparison a member;
* forests: where a list still holds several components, lists that hold much the
  same classes are made one, and tasks over pairs of blocks of it refute pairs by
  parity bitmaps. Of the rows that still have an open partner in another component
  they give back a spanning forest, the likest pairs first, to be verified like the
  hubs' pairs;
* the rest: rows whose lists still hold several components are brought together
  with their whole sets and every open pair is verified on the spot; links come
  back as a forest.

No step gives more rows than it has postings, and no pair that could join two
components is left out. Postings carry two numbers; bitmaps and sets are fetched
for classes that are compared. A list of many documents that are alike but not
linked costs the square of its length in bitmap comparisons, spread over tasks.

Defined cases: null, empty and blank texts have no shingles and stand alone; a
text with fewer words than a shingle is one shingle; copies and repeated rows are
one class; a null id never names a component unless it stands alone; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, components, key_of, let_go, runs, stored, table, temporary, unused

#: Sets up to this size take part with all their tokens.
SHORT = 64
#: Share of a longer set's tokens that a linked pair must share in its l-prefix.
SHARED = 0.10
#: Rounds with one hub for each posting list, before the pairs left are listed.
HUB_ROUNDS = 2
#: Rows and shingles of a block of a posting list, about; a task holds two blocks.
BLOCK, BLOCK_TOKENS = 4096, 1 << 21
#: Bits of a parity bitmap: so many a shingle, rounded up to a power of two, and so
#: many at least; words that are compared at a time.
BITS_EACH, LEAST_BITS, PORTION = 3, 1024, 1 << 21
#: Bits of the filters that spare most texts the second reading, and sets that no
#: pair asks for the shuffle (1 MiB).
FILTER_BITS = 1 << 23

_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n)
    width = min(words, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total + codes[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((_mix(total) >> np.uint64(1)).astype(np.int64))


class Threshold:
    """Prefix lengths for a Jaccard similarity of at least ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, n: int) -> int:
        """Tokens that a set of ``n`` shares with any partner at least."""
        return -(-self.percent * n // 100)

    def shared(self, n: int) -> int:
        return self.overlap(n) if n <= SHORT else min(self.overlap(n), int(np.ceil(SHARED * n)))

    def prefix(self, n: int) -> int:
        """Length of the l-prefix by hash."""
        return n - self.overlap(n) + self.shared(n)

    def posted(self, n: int) -> int:
        """Length of the prefix of the l-prefix under any other order: any
        partner shares at least ``least`` tokens of the two l-prefixes."""
        low, high = self.overlap(n), 100 * n // self.percent
        least = min(self.shared(k) for k in {low, n, high, *([SHORT + 1] if low <= SHORT < high else [])} if k > 0)
        return self.prefix(n) - least + 1


def _third(tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens in the third order."""
    return np.argsort(_mix(tokens.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)), kind="stable")


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bitmap, as 64-bit words, each bit the parity of the tokens that fall on it.

    Two bitmaps differ in at most as many bits as the sets have tokens that the
    other lacks, so a pair whose bitmaps differ in more than a linked pair can is
    refuted for certain. The width grows with the set, so long sets are refuted as
    well as short ones.
    """
    bits = max(LEAST_BITS, 1 << int(BITS_EACH * len(tokens) - 1).bit_length())
    counts = np.bincount((tokens >> 7) & (bits - 1), minlength=bits)
    return np.packbits(counts & 1 == 1, bitorder="little").view("<u8")


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps as they would be at the smaller ``width`` (in words)."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _fits(n, m, differ, percent: int):
    """Whether sizes and differing bits leave it open that a pair is linked."""
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``(doc_id, row, n, key, slack, q)`` of every row: the key of all its columns,
    set size, class key, posted length less prefix length, and the l-prefix."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    limit = Threshold(percent)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for f in frames:
            schema = pa.schema([f.schema.field(0).with_name("doc_id"), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("slack", pa.int32()), ("q", pa.list_(pa.int64()))])

            def rows(f=f):
                for k, t, x, y in zip(f.column(0), f.column(1), f.column(2).to_pylist(), f.column(3).to_pylist(), strict=True):
                    s = shingles(t.as_py(), words)
                    n = len(s)
                    if not n:
                        yield k.as_py(), x, y, 0, None, 0, []
                    else:
                        m = limit.prefix(n)
                        yield k.as_py(), x, y, n, xxhash.xxh64_intdigest(s.tobytes()) >> 1, limit.posted(n) - m, s[:m]

            yield from batches(rows(), schema, 1024)

    row = unused(docs, "row")
    keyed = docs.withColumn(row, key_of(docs, docs.columns)).select("doc_id", "text", f"{row}.x", f"{row}.y")
    found = keyed.mapInArrow(run, f"doc_id {kind}, x long, y long, n long, key long, slack int, q array<long>")
    return found.select("doc_id", F.struct("x", "y").alias("row"), "n", "key", "slack", "q")


def _slot(ids: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(ids.cast("string")), F.lit(FILTER_BITS))


def whole_sets(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``(key, n, s, o, w)`` of the classes in ``classes (key, rep)``: the whole
    set, the posted prefix in the third order and the parity bitmap, from a second
    reading of the texts.

    A filter of fixed size on the ids spares texts that can't be among them; a
    text that passes by chance is left out by the join on the class key.
    """
    spark = docs.sparkSession
    slots = classes.where("rep is not null").select(_slot(F.col("rep")).alias("slot"))
    words64 = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words64["w"].to_numpy()] = words64["b"].to_numpy()
    held = spark.sparkContext.broadcast(bits)
    limit = Threshold(percent)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("s", pa.binary()), ("o", pa.list_(pa.int64())), ("w", pa.binary())])
        for f in frames:

            def rows(f=f):
                for slot, t in zip(f.column(0).to_pylist(), f.column(1), strict=True):
                    if slot is None or bits[slot >> 6] >> (slot & 63) & 1:
                        s = shingles(t.as_py(), words)
                        if len(s):
                            q = s[: limit.prefix(len(s))]
                            yield xxhash.xxh64_intdigest(s.tobytes()) >> 1, len(s), s.tobytes(), q[_third(q)][: limit.posted(len(s))], parity(s).tobytes()

            yield from batches(rows(), schema, 256)

    found = docs.select(F.when(F.col("doc_id").isNotNull(), _slot(F.col("doc_id"))).alias("slot"), "text").mapInArrow(run, "key long, n long, s binary, o array<long>, w binary")
    found = found.join(classes.select("key"), "key", "left_semi")
    return found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "s", "o", "w")])


def asked(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose key is among ``keys (key)``, and a few by chance,
    found without a shuffle of ``sets``: by a filter of fixed size."""
    return split(sets, "key", keys)[1]


def split(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (never null) is not in the table ``keys``, and the others:
    those in it and a few by chance. No row is shuffled: a filter of fixed size decides."""
    slot, at, bits = (unused(rows, x) for x in ("_slot", "_at", "_bits"))
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words64 = keys.select(place.alias(slot)).groupBy(F.floor(F.col(slot) / 64).cast("long").alias(at)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} % 64 as int))")).alias(bits))
    held = rows.withColumn(slot, place).withColumn(at, F.floor(F.col(slot) / 64).cast("long")).join(F.broadcast(words64), at, "left")
    inside = F.coalesce(F.expr(f"shiftrightunsigned({bits}, cast({slot} % 64 as int)) & 1L") == 1, F.lit(False))
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]
    return held.where(~inside).select(*columns), held.where(inside).select(*columns)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key"))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    inside = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * inside >= percent * (len(x) + len(y) - inside)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the threshold.

    Before whole sets are fetched, a pair must fit by size, share a token of the
    third order's prefixes and not be refuted by its bitmaps. Only sets that a pair
    asks for are shuffled, so a round costs what its pairs need.
    """
    pairs = stored(pairs)
    narrow = asked(sets.select("key", "n", "o", "w"), _ends(pairs))
    narrow = [narrow.select(F.col("key").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("n", "o", "w")]) for k in "ab"]
    open_ = pairs.join(narrow[0], "a").join(narrow[1], "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    open_ = open_.where(F.arrays_overlap("oa", "ob")).select("a", "b", "na", "nb", "wa", "wb")

    def narrowed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            keep = []
            for n, m, x, y in zip(f.column(2).to_pylist(), f.column(3).to_pylist(), f.column(4).to_pylist(), f.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8")[None], np.frombuffer(y, "<u8")[None]
                width = min(x.shape[1], y.shape[1])
                keep.append(bool(_fits(n, m, int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()), percent)))
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = stored(open_.mapInArrow(narrowed, "a long, b long"))
    whole = asked(sets.select("key", "s"), _ends(both))
    both = both.join(whole.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def exact(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            keep = [_linked(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), percent) for x, y in zip(f.column(2), f.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(exact, "a long, b long")


def lists_once(rows: DataFrame, label: str) -> DataFrame:
    """``rows (tok, key, …)`` of the lists that hold several values of ``label``; of
    lists with the same keys (by two 64-bit hashes and their number) one, as the
    others hold the same pairs."""
    lists = rows.groupBy("tok").agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "key")).alias("y"))
    one = lists.where("lo <> hi").groupBy("size", "x", "y").agg(F.min("tok").alias("tok")).select("tok")
    return rows.join(one, "tok", "left_semi")


def lists_merged(rows: DataFrame) -> DataFrame:
    """``rows (tok, key, c)`` with lists that hold much the same keys made one: those
    whose smallest hash of a key is the same, as it is for two lists in so many cases
    of a hundred as they share keys. Keys that meet in a list meet in its union."""
    names = rows.groupBy("tok").agg(F.min(F.xxhash64("key")).alias("name"))
    return rows.join(names, "tok").select(F.col("name").alias("tok"), "key", "c").distinct()


def postings(signed: DataFrame) -> DataFrame:
    """``(tok, key)``: what each class posts after the first two orders."""
    each = signed.where("key is not null").select("key", "slack", F.explode("q").alias("tok"))
    # Counts stand beside the rows they count, so each token is shuffled once.
    of_token, of_class = Window.partitionBy("tok"), Window.partitionBy("key")
    each = each.withColumns({"c": F.count("*").over(of_token), "lo": F.min("key").over(of_token), "hi": F.max("key").over(of_token)})
    found = each.where("lo <> hi").groupBy("key", "tok").agg(F.first("slack").alias("slack"), F.first("c").alias("c"))
    found = found.withColumn("size", F.count("*").over(of_class)).withColumn("rank", F.row_number().over(of_class.orderBy("c", "tok")))
    found = stored(found.where(F.col("rank") <= F.col("slack") + F.col("size")).select("tok", "key"))
    # A token that only one class posts after the filter makes no pair.
    return lists_once(found, "key")


class _Group:
    """Rows of one pair of blocks: which pairs of different components are open."""

    def __init__(self, g: pa.Table, percent: int):
        self.percent = percent
        self.key, self.n, self.c, self.block = (g[x].to_numpy() for x in ("key", "n", "c", "block"))
        self.i, self.j = int(g["i"][0].as_py()), int(g["j"][0].as_py())
        raw = g["w"].to_pylist()
        self.width = np.array([len(w) // 8 for w in raw])
        self.words = {}
        for width in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == width)
            self.words[width] = at, np.frombuffer(b"".join(raw[k] for k in at), "<u8").reshape(len(at), -1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(x, y, differing bits)`` of the open pairs, in bounded portions."""
        names, at = np.unique(self.c, return_inverse=True)
        odd = at != np.bincount(at).argmax()  # most rows may be of one component
        for width, (rows, words) in self.words.items():
            for other, (cols, more) in self.words.items():
                if other >= width:
                    more = folded(more, width)
                    # A pair of one component is settled, so one side is odd.
                    x, y = odd[rows], odd[cols]
                    yield from self._portions(rows[x], words[x], cols, more)
                    if other > width:
                        yield from self._portions(rows[~x], words[~x], cols[y], more[y])

    def _portions(self, x, xw, y, yw):
        if not len(x) or not len(y):
            return
        step = max(1, PORTION // (len(y) * xw.shape[1]))
        for start in range(0, len(x), step):
            p = x[start : start + step]
            n, m = self.n[p][:, None], self.n[y][None]
            r, q = np.nonzero((np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent) & (self.c[p][:, None] != self.c[y][None]) & (((self.block[p] == self.i)[:, None] & (self.block[y] == self.j)[None]) | ((self.block[p] == self.j)[:, None] & (self.block[y] == self.i)[None])))
            if not len(r):
                continue
            differ = np.bitwise_count(xw[start + r] ^ yw[q]).sum(1, dtype=np.int64)
            keep = _fits(self.n[p[r]], self.n[y[q]], differ, self.percent)
            yield p[r[keep]], y[q[keep]], differ[keep]


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Numbers of the edges ``a - b`` of a cheapest spanning forest over the
    components ``label``, which takes up their names."""
    order = np.argsort(cost, kind="stable")
    out = []
    while True:
        order = order[label[a[order]] != label[b[order]]]
        if not len(order):
            return np.concatenate(out) if out else np.zeros(0, np.int64)
        first = np.full(len(label), len(order))
        rank = np.arange(len(order))
        np.minimum.at(first, label[a[order]], rank)
        np.minimum.at(first, label[b[order]], rank)
        chosen = order[np.unique(first[first < len(order)])]
        out.append(chosen)
        x, y = label[a[chosen]], label[b[chosen]]
        root = np.arange(len(label))
        while True:
            low = root.copy()
            np.minimum.at(low, x, root[y])
            np.minimum.at(low, y, root[x])
            low = low[low]
            if (low == root).all():
                break
            root = low
        label[:] = root[label]


def _blocked(left: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``left (tok, key, c)`` with columns of its sets, dealt to pairs of blocks
    ``(tok, i, j)``, so no task holds a whole list."""
    rows = left.join(asked(sets.select("key", "n", *columns), left.select("key")), "key")
    sizes = rows.groupBy("tok").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("long").alias("blocks"))
    rows = rows.join(sizes, "tok").withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("tok", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "key", "n", "c", *columns)
    return rows.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")


def likely(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that would join all components that meet in a list of ``left
    (tok, key, c)`` and that bitmaps leave open: per pair of blocks a spanning
    forest, the likest pairs first, so fewer pairs than rows."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(frames, 3):
            group = _Group(g, percent)
            label = np.unique(group.c, return_inverse=True)[1]
            for x, y, differ in group.pairs():
                at = spanning(label, label[x], label[y], differ)
                a, b = group.key[x[at]], group.key[y[at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _blocked(left, sets, ["w"]).mapInArrow(run, "a long, b long").distinct()


def still_open(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``left (tok, key, c)`` that have an open partner in their list."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(frames, 3):
            group = _Group(g, percent)
            hit = np.zeros(len(group.key), bool)
            for x, y, _ in group.pairs():
                hit[x] = hit[y] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hit.sum()), g["tok"][0].as_py())), pa.array(group.key[hit]), pa.array(group.c[hit])], names=["tok", "key", "c"])

    return _blocked(left, sets, ["w"]).mapInArrow(run, "tok long, key long, c long").distinct()


def certain(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that span all components that are linked within a list of
    ``left (tok, key, c)``: every open pair is verified where its rows meet."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(frames, 3):
            group = _Group(g, percent)
            s = g["s"].to_pylist()
            label = np.unique(group.c, return_inverse=True)[1]
            for x, y, differ in group.pairs():
                out = []
                for k in np.argsort(differ, kind="stable").tolist():
                    i, j = x[k], y[k]
                    if label[i] != label[j] and _linked(np.frombuffer(s[i], np.int64), np.frombuffer(s[j], np.int64), percent):
                        label[label == label[j]] = label[i]
                        out.append(k)
                a, b = group.key[x[out]], group.key[y[out]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _blocked(left, sets, ["w", "s"]).mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, signed: DataFrame, left: DataFrame, words: int, percent: int) -> DataFrame:
    """``(node, component)`` over class keys: classes that are linked, from the
    postings ``left (tok, key)``.

    Every pair of classes that reaches the threshold ends in one component, and
    no other pair is joined directly.
    """
    reps = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    sets = stored(whole_sets(docs, reps.join(left.select("key").distinct(), "key", "left_semi"), words, percent))
    left = left.withColumn("c", F.col("key"))
    joined = None
    for turn in range(HUB_ROUNDS + 2):
        if turn < HUB_ROUNDS:
            hub = left.groupBy("tok").agg(F.min(F.struct("key", "c")).alias("h")).select("tok", F.col("h.key").alias("hub"), F.col("h.c").alias("hc"))
            against = left.join(hub, "tok").where("key <> hub")
            pairs = against.where("c <> hc").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
            found = stored(verify(pairs, sets, percent))
            left = against.select("tok", "key", "c")  # the hub is done in its lists
        elif turn == HUB_ROUNDS:
            left = stored(still_open(lists_merged(left), sets, percent))  # of what is left, bitmaps leave little
            found = stored(verify(likely(left, sets, percent), sets, percent))
        else:
            found = stored(certain(left, sets, percent))
        # Components and their union are carried on, not all edges again.
        joined = components(found if joined is None else found.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if turn > HUB_ROUNDS:
            break
        left = left.drop("c").join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
        left = stored(lists_once(left, "c"))
        if left.isEmpty():
            break
    return joined


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, row, n_shingles, class_key, group, component_id)`` of every row of
    ``docs``.

    ``component_id`` is the smallest id that can be reached by links of pairs
    whose Jaccard similarity is at least ``percent`` in a hundred (null if no such
    row has an id); ``group`` is a key of the same component.
    """
    with temporary() as scratch:
        with temporary() as first:  # the l-prefixes go when they are posted
            whole = stored(signatures(docs, words, percent))
            signed = scratch.keep(whole.select("doc_id", "row", "n", "key"))
            left = first.keep(postings(whole))
        joined = scratch.keep(links(docs, signed, left, words, percent))
    reps = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    named = reps.join(joined, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("g"))
    least = named.groupBy("g").agg(F.min("rep").alias("least"))
    named = named.join(least, "g").select("key", "g", "least")
    out = signed.select("doc_id", "row", "n", "key").join(named, "key", "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.col("g").alias("group"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the
    smallest id, null last; of several with that id, the one whose key over all
    columns is smallest, and of rows equal in all columns one. Texts without words
    all stay. Columns beside ``doc_id`` and ``text`` are carried along, whatever
    their names; an empty table gives an empty table.
    """
    key, stays = unused(docs, "row"), unused(docs, "stays")
    with temporary() as scratch:
        each = stored(near_duplicates(docs, words, percent).where("group is not null").select("doc_id", "row", "group"))
        first = each.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
        rows = each.groupBy("row").agg(F.count("*").alias("times")).join(first, "row", "left")
        # Rows that stay and have no equal need no mention.
        rows = scratch.keep(rows.where("stays is null or times > 1").select(F.col("row").alias(key), F.coalesce("stays", F.lit(False)).alias(stays)))
    # A row whose key no filter holds stays without a shuffle of its text.
    keyed = docs.withColumn(key, key_of(docs, docs.columns))
    spared, hit = split(keyed, key, rows)
    hit = hit.join(rows, key, "left")
    kept = spared.drop(key).unionByName(hit.where(F.col(stays).isNull()).drop(key, stays))
    return kept.unionByName(hit.where(stays).dropDuplicates([key]).drop(key, stays))


#: All pairs that share a shingle, and what can be reached from each document.
ORACLE_SQL = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 m AS MATERIALIZED (SELECT a.doc_id AS s, b.doc_id AS d, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS MATERIALIZED (SELECT m.s, m.d FROM m JOIN n x ON x.doc_id = m.s JOIN n y ON y.doc_id = m.d WHERE 100 * c >= 85 * (x.n + y.n - c)),
 r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.d, r.root FROM r JOIN l ON l.s = r.node)
 SELECT node AS doc_id, coalesce(max(n.n), 0)::bigint AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY node"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")
