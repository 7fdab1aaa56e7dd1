"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Text is lower-cased after names are marked, and punctuation goes. Numbers become `#`, units after numbers `@`, names (capitalised
words inside a sentence) `&`. Windows of WINDOW template words, or the whole of a shorter item, are hashed; a document's windows, of
WINDOW words and of each length that shorter items have, meet the benchmark's by equal hash. Where the raw words differ, windows of fewer than LITERALS literal words say nothing and are left
out, and the slots are checked by occurrence, which is an item at one place of a text (document position less item position): within
it no slot value of the item may stand for two of the document.
A document is contaminated by one verbatim window, or by one consistent occurrence of an item with a re-filled slot.

Edge cases: null or empty text has no windows; documents shorter than a window meet only items no longer; repeated rows are
judged each; null ids are kept; an empty benchmark flags nothing; columns other than ids and text pass by untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: A power of two.
WINDOW = 8
LITERALS = 5
#: Words of a block.
BLOCK = 512
#: A benchmark over this many windows is joined by shuffle instead of a broadcast.
BROADCAST_WINDOWS = 200_000
#: Fixed unit words that follow a number.
UNITS = ("mm", "cm", "km", "kg", "mg", "lb", "oz", "ml", "mph", "kmh", "meters", "metres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "litres", "liters", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent")
# each pattern begins with the character that is rare, and looks behind it afterwards
_NAME = r" (?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})"
_PUNCT = r"[^\p{L}\p{M}\p{N}\s\x01]+"


def raw_words(text: str = "text"):
    """Words, names with a leading \\x01."""
    t = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _NAME, " \x01"))
    # digits grouped by points or commas are one number
    t = F.regexp_replace(t, r"[.,](?<=\p{N}[.,])(?=\p{N})", "")
    return F.array_remove(F.split(F.regexp_replace(t, _PUNCT, ""), r"\s+"), "")


def template_words(raw):
    """Template of joined raw words: the same number of words, slots replaced. Nothing is done where there is no slot."""
    joined = F.array_join(raw, " ")
    units = "|".join(UNITS)
    out = F.regexp_replace(joined, r"\x01(?<![^ ]\x01)[^ ]+", "&")
    out = F.regexp_replace(out, rf"\p{{N}}(?<![^ ]\p{{N}})\p{{N}}* (?:{units})(?![^ ])", "# @")
    out = F.regexp_replace(out, rf"\p{{N}}(?<![^ ]\p{{N}})\p{{N}}*(?:{units})?(?![^ ])", "#")
    return F.when(F.rlike(joined, F.lit(r"[\x01\p{N}]")), F.split(out, " ")).otherwise(raw)


def _shifted_hash(h, by: int):
    """Hash of each element with the one `by` places later; the last `by` have none."""
    left, right = F.slice(h, 1, F.greatest(F.size(h) - by, F.lit(0))), F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def located(rows: DataFrame, key: str, lengths: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """(key, text) -> a row per window of each of the lengths: key, row (one number a row), words (of the text), n, tpl (hash of its
    template), pos; w, t and at: words of its block and its place there.

    Blocks of BLOCK words bound what a row carries, however long the text. explode_outer keeps the optimizer from working arrays out
    once more in a filter; rows without windows have no tpl.
    """
    r = rows.select(F.col(f"`{key}`"), F.monotonically_increasing_id().alias("row"), raw_words().alias("w")).select(key, "row", "w", template_words(F.col("w")).alias("t"))
    # t is named more than once, and so isn't worked out anew for each block
    starts = F.when(F.size("t") >= min(lengths), F.sequence(F.lit(0), F.size("t") - min(lengths), F.lit(BLOCK)))
    block = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("w", s + 1, BLOCK + WINDOW - 1).alias("w"), F.slice("t", s + 1, BLOCK + WINDOW - 1).alias("t")))
    r = r.select(key, "row", F.size("t").alias("words"), block.alias("blocks")).select(key, "row", "words", F.explode_outer("blocks").alias("b")).select(key, "row", "words", "b.start", "b.w", "b.t")
    # windows of 1, 2, 4 and then 8 words
    r, by = r.withColumn("h1", F.transform("t", lambda x: F.xxhash64(x))), 1
    while 2 * by <= max(lengths):
        r = r.withColumn(f"h{2 * by}", _shifted_hash(F.col(f"h{by}"), by))
        by *= 2
    made = F.array(*[F.struct(F.lit(n).alias("n"), F.slice(_window_hashes(n), 1, BLOCK).alias("h")) for n in lengths])
    r = r.select(key, "row", "words", "start", "w", "t", F.explode_outer(made).alias("made")).select(key, "row", "words", "start", "w", "t", "made.n", "made.h")
    return r.select(key, "row", "words", "n", "start", "w", "t", F.posexplode_outer("h").alias("at", "tpl")).select(key, "row", "words", "n", "tpl", (F.col("start") + F.col("at")).alias("pos"), "w", "t", "at")


def _window_hashes(n: int):
    """Hashes of windows of n words, put together from those of powers of two."""
    out, done = None, 0
    for by in (8, 4, 2, 1):
        if n & by:
            h = F.col(f"h{by}")
            size = F.greatest(F.size(h) - done, F.lit(0))
            out = h if out is None else F.zip_with(F.slice(out, 1, size), F.slice(h, done + 1, size), lambda a, b: F.xxhash64(a, b))
            done += by
    return out


def detailed(found: DataFrame, *columns: str) -> DataFrame:
    """Of located windows the columns, raw (hash of the raw words) and slots (the words in slots)."""
    one = F.arrays_zip(F.slice("w", F.col("at") + 1, F.col("n")).alias("w"), F.slice("t", F.col("at") + 1, F.col("n")).alias("t"))
    slots = F.transform(F.filter(one, lambda x: x["t"].isin("#", "@", "&")), lambda x: x["w"])
    return found.select(*columns, F.xxhash64(F.slice("w", F.col("at") + 1, F.col("n"))).alias("raw"), slots.alias("slots"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, verbatim, refilled): windows each document shares with each item, after the slot check."""
    all_lengths = tuple(range(1, WINDOW + 1))
    own = located(benchmark, "item_id", all_lengths).where(F.col("tpl").isNotNull() & (F.col("n") == F.least(F.col("words"), F.lit(WINDOW))))
    own = detailed(own, "item_id", "tpl", "n", "pos")
    # every item and place that has a window, so that what items share counts for each
    own = stored(own)
    small = own.count() <= BROADCAST_WINDOWS
    items = own.select("item_id", F.col("pos").alias("b_pos"), F.col("tpl").alias("b_tpl"), F.col("raw").alias("b_raw"), F.col("n").alias("b_n"), F.col("slots").alias("b_slots"))
    kinds = own.select(F.col("tpl").alias("k_tpl"), F.col("n").alias("k_n")).distinct()

    def sent(x: DataFrame) -> DataFrame:
        return F.broadcast(x) if small else x

    # only windows that meet need their slots; each of them is worked out once, however many of the benchmark's share its template
    lengths = tuple(sorted({WINDOW} | {r["n"] for r in own.select("n").distinct().collect()}))
    near = located(docs, "doc_id", lengths).join(sent(kinds), (F.col("tpl") == F.col("k_tpl")) & (F.col("n") == F.col("k_n")), "left_semi")
    near = stored(detailed(near, "doc_id", "row", "tpl", "n", "pos"))
    equal = (F.col("tpl") == F.col("b_tpl")) & (F.col("n") == F.col("b_n"))
    verbatim = near.join(sent(items), equal & (F.col("raw") == F.col("b_raw")))
    refilled = near.join(sent(items.where(F.col("b_n") - F.size("b_slots") >= LITERALS)), equal).where(F.col("raw") != F.col("b_raw"))
    met = [x.select("doc_id", "row", "item_id", "pos", (F.col("pos") - F.col("b_pos")).alias("place"), F.lit(same).alias("same"), "slots", "b_slots") for x, same in ((verbatim, True), (refilled, False))]
    met = stored(met[0].unionByName(met[1]))
    return counted(met)


def counted(met: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, pos, place, same, slots, b_slots), a row per meeting -> what hits() returns."""
    # re-filled slots: within an occurrence each value of the item keeps one value in the document
    occurrence = ("row", "item_id", "place")
    pairs = met.where("not same").select(*occurrence, F.explode(F.arrays_zip("b_slots", "slots")).alias("z"))
    broken = pairs.groupBy(*occurrence, "z.b_slots").agg(F.min("z.slots").alias("lo"), F.max("z.slots").alias("hi")).where("lo <> hi")
    broken = broken.select(*[F.col(c).alias(f"x_{c}") for c in occurrence]).distinct()
    at = [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in occurrence]
    whole = met.where("not same").join(broken, at, "left_anti").unionByName(met.where("same"))
    # a window that is verbatim at one place isn't counted as re-filled at another
    windows = whole.groupBy("doc_id", "row", "item_id", "pos").agg(F.max("same").alias("same"))
    return windows.groupBy("doc_id", "item_id").agg(F.count(F.when(F.col("same"), 1)).alias("verbatim"), F.count(F.when(~F.col("same"), 1)).alias("refilled"))


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per contaminated document: doc_id, item_id (its most shared item), windows, items."""
    found = hits(docs, benchmark)
    return found.groupBy("doc_id").agg(F.max_by("item_id", F.struct(F.col("verbatim") + F.col("refilled"), -F.col("item_id"))).alias("item_id"), F.sum(F.col("verbatim") + F.col("refilled")).alias("windows"), F.count("*").alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the contaminated ones, columns as they are."""
    bad = flagged(docs, benchmark).select(F.col("doc_id").alias("bad_id_"))
    return docs.join(bad, F.col("doc_id") == F.col("bad_id_"), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents: doc_id, item_id, windows, items."""
    return flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
