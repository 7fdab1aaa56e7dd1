"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Weights 5, 2, 1 repeat over the sources in code-point order, null last. Targets share all words by weight; a target above 3
times its source's size stops there, and the rest is shared again (water filling, in closed form over the sorted caps).
The schedule has SLOTS slots. Slot i holds the golden-ratio point frac(i * phi), which falls into one source's stretch of the
cumulative targets; slots of a source are ranked. A source's documents lie in hashed order on a line of words that repeats
endlessly; its n slots take n blocks of equal words from it, together exactly its target, so slot rank r stands for words
[r * target / n, (r + 1) * target / n) of that line. Each document's words on the line, in each round, are joined with the blocks they
lie in by block number; what it gives is the sum over these pieces, and (slot, at) of the pieces is the order of the mix.

Edge cases: empty or null text has size 0 and takes 0; a source without words has target 0; repeated rows are mixed as rows
of their own, and so are those with a null id; an empty table gives an empty result; other columns pass by untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (5, 2, 1)
LIMIT = 3
SLOTS = 1 << 16
#: Hash cells of a source; its running sum of words is first over cells, then within each, so that no source is one group.
CELLS = 1024
PHI = "0.6180339887498949"


def with_word_count(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the number of runs of anything but ASCII white space in a column; null: 0. The column itself goes.

    White space becomes single blanks by plain replacement; only where blanks then follow each other does a pattern run. Each step is a
    projection of its own, so that none is worked out twice.
    """
    flat = F.col(text)
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    flat_ = F.col(text)
    docs = docs.withColumn(text, F.trim(flat))
    docs = docs.withColumn(text, F.when(F.contains(flat_, F.lit("  ")), F.regexp_replace(flat_, " +", " ")).otherwise(flat_))
    gaps = F.octet_length(flat_) - F.octet_length(F.replace(flat_, F.lit(" "), F.lit("")))
    return docs.withColumn(name, F.when(flat_.isNull() | (flat_ == ""), F.lit(0)).otherwise(gaps + 1).cast("long")).drop(text)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target. Few rows: one a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", LIMIT * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    s = (
        s.withColumn("below", F.coalesce(F.sum("cap").over(up), F.lit(0)))
        .withColumn("weight_on", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("below")) / F.col("weight_on"))
    )
    # in order of cap / weight the sources stop until one doesn't; its level then holds for all the rest
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return s.withColumn("final", level).withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap").cast("double")))).select("source", "source_size", "weight", "target")


def schedule(spark: SparkSession, goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The slots themselves: (slot, source, rank, from_word, to_word) on each source's repeating line."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    ends = goals.withColumn("to", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("target").over(whole)).select("source", "target", ((F.col("to") - F.col("target")) / F.col("all")).alias("lo"), (F.col("to") / F.col("all")).alias("hi"))
    point = spark.range(0, slots, 1, 8).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(PHI).cast("double") % 1.0).alias("u"))
    cells = ends.where("hi > lo").select("source", "target", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * 100).cast("int"), F.floor(F.col("hi") * 100).cast("int"))).alias("cell"))
    hit = point.withColumn("cell", F.floor(F.col("u") * 100).cast("int")).join(cells, "cell").where("u >= lo and u < hi")
    # a target smaller than a slot may get no point: it has one slot, after all the others
    lost = ends.where("hi > lo").join(hit.select(F.col("source").alias("s")).distinct(), F.col("source").eqNullSafe(F.col("s")), "left_anti").select(F.lit(slots).cast("long").alias("slot"), "source", "target")
    all_slots = hit.select("slot", "source", "target").unionByName(lost)
    n = F.count("*").over(Window.partitionBy("source"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    whole_target = F.round("target").cast("long")
    return all_slots.select("slot", "source", "target", rank.alias("rank"), n.alias("n")).select("slot", "source", "rank", F.floor(F.col("rank") * whole_target / F.col("n")).cast("long").alias("from_word"), F.floor((F.col("rank") + 1) * whole_target / F.col("n")).cast("long").alias("to_word"))


def mixed(docs: DataFrame, with_text: bool = True, slots: int = SLOTS) -> DataFrame:
    """documents -> every row with size, source_size, target (double), taken (long) and slots (array of slot, at, words: the pieces of the
    row that slots take, at: words of the slot's block before it); with_text also keeps its other columns.

    Sizes are summed by source and hashed cell first; what a task orders is one cell, a small share of any source.
    """
    spark = docs.sparkSession
    made = ("size", "source_size", "target", "taken", "slots")
    own = [c for c in docs.columns if c not in made] if with_text else ["doc_id", "source"]
    # rows without an id are spread by their text
    cell = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")), F.lit("cell")), F.lit(CELLS)).cast("int")
    fixed = {"row_": F.monotonically_increasing_id(), "id_": F.col("doc_id"), "source_": F.col("source"), "cell_": cell, "text_": F.col("text")}
    rows = docs.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in own], *[x.alias(c) for c, x in fixed.items()])
    # stored, so that row_ stays the same for each use
    sized = stored(with_word_count(rows, "text_", "size_"))
    small = sized.groupBy(F.col("source_").alias("source"), F.col("cell_").alias("cell")).agg(F.sum("size_").alias("cell_size"))
    small = stored(small)
    goals = stored(targets(small.groupBy("source").agg(F.sum("cell_size").cast("long").alias("source_size"))))
    dealt = stored(schedule(spark, goals, slots))
    met = _on_lines(sized.select("row_", "id_", "source_", "cell_", "size_"), small, goals, dealt)
    # block numbers, with one to spare on either side for rounding; pieces without words go
    low, high = F.floor(F.col("begin") * F.col("n") / F.col("words")) - 1, F.floor(F.col("end") * F.col("n") / F.col("words")) + 1
    ranks = F.sequence(F.greatest(low.cast("long"), F.lit(0).cast("long")), F.least(high.cast("long"), F.col("n") - 1))
    met = met.withColumn("rank_", F.explode_outer(F.when(F.col("round").isNotNull(), ranks)))
    blocks = dealt.select("slot", F.col("source").alias("s4"), F.col("rank").cast("long").alias("r4"), "from_word", "to_word")
    met = met.join(F.broadcast(blocks), F.col("source_").eqNullSafe(F.col("s4")) & (F.col("rank_") == F.col("r4")), "left")
    start = F.greatest("begin", "from_word")
    piece = F.struct("slot", (start - F.col("from_word")).alias("at"), (F.least("end", "to_word") - start).alias("words"))
    met = met.withColumn("piece", F.when(F.col("slot").isNotNull() & (piece["words"] > 0), piece))
    taken = met.groupBy("row_", "id_", "source_", "size_", "source_size", "target").agg(
        F.coalesce(F.sum("piece.words"), F.lit(0)).cast("long").alias("taken"), F.sort_array(F.collect_list("piece")).alias("slots")
    )
    if not with_text:
        names = {"doc_id": "id_", "source": "source_", "size": "size_"}
        return taken.select(*[F.col(c).alias(n) for n, c in names.items()], "source_size", "target", "taken", "slots")
    taken = taken.select(F.col("row_").alias("row2_"), "source_size", "target", "taken", "slots")
    both = sized.join(taken, F.col("row_") == F.col("row2_"))
    return both.select(*[F.col(f"own_{c}").alias(c) for c in own], F.col("size_").alias("size"), "source_size", "target", "taken", "slots")


def _on_lines(rows: DataFrame, small: DataFrame, goals: DataFrame, dealt: DataFrame) -> DataFrame:
    """Rows with where their words begin and end on their source's line, one for each round of the line that the blocks reach."""
    # a source's equal blocks, in rank order, fill [0, words) of its line
    filled = dealt.groupBy(F.col("source").alias("s3")).agg(F.max("to_word").alias("words"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("cell_size").over(before), F.lit(0)).cast("long").alias("offset")
    cells = small.select(F.col("source").alias("s1"), F.col("cell").alias("c1"), offset)
    cells = cells.join(goals.select(F.col("source").alias("s2"), "source_size", "target"), F.col("s1").eqNullSafe(F.col("s2")))
    cells = cells.join(filled, F.col("s1").eqNullSafe(F.col("s3")), "left")
    cells = cells.select("s1", "c1", "offset", "source_size", "target", F.coalesce("words", F.lit(0)).alias("words"), "n")
    inside = Window.partitionBy("source_", "cell_").orderBy(F.xxhash64("id_", F.lit("shuffle")), "id_", "size_")
    at = F.coalesce(F.sum("size_").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    met = rows.withColumn("at_", at).join(cells, F.col("source_").eqNullSafe(F.col("s1")) & (F.col("cell_") == F.col("c1")))
    # the row's words in each round that begins within [0, words), cut there
    first, total, words = F.col("offset") + F.col("at_"), F.col("source_size"), F.col("words")
    last = F.floor((words - 1 - first) / total).cast("long")
    rounds = F.when((F.col("size_") > 0) & (first < words), F.sequence(F.lit(0).cast("long"), last))
    kept = ("row_", "id_", "source_", "size_", "source_size", "target", "words", "n")
    met = met.select(*kept, first.alias("first"), F.explode_outer(rounds).alias("round"))
    begin = F.col("first") + F.col("round") * total
    return met.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size_"), words))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "size", "source_size", "target", "taken", "slots")
