"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong findings (assignments, access identifiers, long hexadecimal strings) are
reported always. Weak candidates (identifiers of accounts, bare key material,
endpoints) are reported only when a complementary part stands within
``SCOPE`` code points: a band join of the parts of one text on their intervals,
run as running aggregates over sorted parts, so no pairs are built.

Positions come from the text between the matches: ``split`` and
``regexp_extract_all`` use the same pattern, and the running sum of the lengths
gives each match's start in code points. One row per match is shuffled, never a
text.

Defined cases: null text is the empty text; every row of the table gives one
row, rows with equal or null ids stay separate; nothing found gives zero counts,
the digest of the empty string and an empty ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import key_of, stored, table, unused

#: Two parts belong together when the gap between them is at most this long.
SCOPE = 200
#: Code points of a piece of a text that is being masked.
CHUNK = 2048

#: Strong kinds in their order: (kind, pattern, group that must be long, least length).
STRONG = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: Weak kinds, the kinds that complete each, and a least length.
WEAK = (
    ("ident", r"""(?i:client_id|access_key_id|account_id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 4, ("assign", "hex", "key", "access")),
    ("key", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}+={0,2}", 0, 32, ("access", "ident", "endpoint")),
    ("endpoint", r"""(?i:https?|s3|jdbc|postgres|mysql|redis|amqp|mongodb)://[^\s"'<>]+""", 0, 10, ("access", "assign", "key")),
)

KINDS = [k[0] for k in STRONG] + [k[0] for k in WEAK]

#: Parts that take precedence where they overlap a weak one.
ABOVE = {"endpoint": ("assign", "access", "hex"), "ident": ("assign", "access", "hex", "endpoint"), "key": ("assign", "access", "hex", "endpoint", "ident")}


def _beside(kinds: tuple[str, ...]) -> tuple[Column, Column]:
    """The last end of those ``kinds`` that start no later than the row, and the
    first start of those that start no earlier, within one text: two running
    aggregates, linear in the number of matches."""
    mine = F.col("ord").isin([KINDS.index(k) for k in kinds])
    up = Window.partitionBy("_row").orderBy("start")
    down = Window.partitionBy("_row").orderBy(F.col("start").desc())
    return F.max(F.when(mine, F.col("end"))).over(up), F.min(F.when(mine, F.col("start"))).over(down)


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """For each match: its kind and place, the length of the text before it
    since the last match, its length, and the length of ``group``."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.transform(
        F.arrays_zip(whole.alias("w"), part.alias("g"), F.slice(gaps, 1, F.size(whole)).alias("b")),
        lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("ord"),
            i.alias("i"),
            F.char_length(m["b"]).alias("gap"),
            F.char_length(m["w"]).alias("len"),
            F.char_length(m["g"]).alias("group_len"),
        ),
    )
    none = F.array().cast("array<struct<ord:int,i:int,gap:int,len:int,group_len:int>>")
    return F.when(F.contains(text, F.lit("AKIA")) & text.rlike(pattern) if kind == "access" else text.rlike(pattern), zipped).otherwise(none)


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, found)``: all reported spans of every text.

    ``found`` is an array of ``(start, ord, end, kind, strong, before)`` by start,
    then kind; code points, end exclusive; ``before`` is the largest end of the
    spans that stand earlier in it, else 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in (*STRONG, *WEAK)]), F.col("m.ord") + 1)
    base = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text.alias("text"))
    found = F.concat(*[_matches(F.col("text"), k[0], k[1], k[2]) for k in (*STRONG, *WEAK)])
    rows = base.select("_row", "doc_id", found.alias("ms")).select("_row", "doc_id", F.explode_outer("ms").alias("m"))

    running = Window.partitionBy("_row", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("_row", "doc_id", F.col("m.ord").alias("ord"), F.col("m.i").alias("i"), F.col("m.gap").alias("gap"), F.col("m.len").alias("len"), (F.col("m.group_len") >= least).alias("holds"))
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(running).cast("long"))
    rows = rows.withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("ord", F.when(F.col("holds"), F.col("ord")))  # failing matches are dropped, their text stays used up

    # A weak part that overlaps one of higher rank is no part of its own.
    for kind, above in ABOVE.items():
        before, after = _beside(above)
        rows = rows.withColumn(f"_{kind}", (F.col("ord") == KINDS.index(kind)) & F.coalesce((before > F.col("start")) | (after < F.col("end")), F.lit(False)))
    rows = rows.withColumn("ord", F.when(~F.coalesce(*[F.when(F.col(f"_{k}"), True) for k in ABOVE], F.lit(False)), F.col("ord")))

    # The band join: the nearest complementary part on either side is within the scope.
    for kind, _, _, _, partners in WEAK:
        before, after = _beside(partners)
        rows = rows.withColumn(f"_{kind}", (F.col("ord") == KINDS.index(kind)) & F.coalesce((F.col("start") - before <= scope) | (after - F.col("end") <= scope), F.lit(False)))
    keep = (F.col("ord") < len(STRONG)) | F.coalesce(*[F.when(F.col(f"_{k[0]}"), True) for k in WEAK], F.lit(False))
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = rows.withColumn("ord", F.when(keep, F.col("ord")))
    earlier = Window.partitionBy("_row").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.max(F.when(F.col("ord").isNotNull(), F.col("end"))).over(earlier), F.lit(0).cast("long")))
    span = F.struct("start", "ord", "end", F.element_at(names, F.col("ord") + 1).alias("kind"), (F.col("ord") < len(STRONG)).alias("strong"), "before")
    rows = rows.withColumn("span", F.when(F.col("ord").isNotNull(), span))
    return rows.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("span")).alias("found")).drop("_row")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    strong = F.filter("found", lambda s: s["strong"])
    counts = [F.size(F.filter("found", _is(k[0]))).cast("long").alias(f"n_{k[0]}") for k in STRONG]
    return found.select("doc_id", *counts, F.sha2(_joined(strong), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` out of pieces of ``CHUNK`` code points: at
    most two pieces are cut, so the cost doesn't grow with the place in the text."""
    i, j = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    first, last = (start % CHUNK + 1).cast("int"), (end % CHUNK).cast("int")
    at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    inside = F.substring(at(i), first, (end - start).cast("int"))
    across = F.concat(F.substring(at(i), first, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), last))
    return F.when(i == j, inside).otherwise(across)


def mask(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by its kind in brackets, and
    ``n_chars`` set to the new length where there is one.

    A span inside an earlier one adds nothing, one that overlaps its end prolongs
    it. A null text stays null, repeated rows stay as many as they are, other
    columns are carried along whatever their names, and an empty table gives an
    empty table. Spans come back to their texts by a key of the text.
    """
    key, spans, pieces = unused(docs, "key"), unused(docs, "spans"), unused(docs, "pieces")
    keyed = docs.select(key_of(docs, ["text"]).alias("doc_id"), "text").where("text is not null")
    found = find_secrets(keyed, scope).where(F.size("found") > 0).dropDuplicates(["doc_id"])
    found = stored(found.select(F.col("doc_id").alias(key), F.col("found").alias(spans)))
    hit = docs.withColumn(key, key_of(docs, ["text"])).join(found, key, "left")
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    hit = hit.withColumn(pieces, F.when(F.col(spans).isNotNull(), chunks))
    new = F.filter(spans, lambda s: s["start"] >= s["before"])
    parts = F.transform(new, lambda s: F.concat(_between(F.col(pieces), s["before"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
    tail = _between(F.col(pieces), F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length("text").cast("long"))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    hit = hit.withColumn("text", text)
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return hit.drop(key, spans, pieces)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))
