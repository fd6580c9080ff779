"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid out in the order of a hash on an axis of words and cut into
blocks of equal length.  Golden-ratio points mapped through the cumulative weights deal out
slots to sources; a source's slots are ranked, and slot r takes block r of that source,
starting over when all are used.  The last slot is clipped at the target, so each source gives
its target to the word and no document is taken more than twice.

Hot sources: ranks and places along a source are prefix sums over small ranges (of slots, of
the hash), so no source is ordered in one task.  What is ordered whole is one row per source.

Defined results
* Null text has size 0.  A null source is a source of its own and comes last.
* Rows that share id, source and size are interchangeable copies; each takes its own words.
* Documents without words, or all sources empty, take 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.tables import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2
BLOCK_WORDS = 65_536
#: The fractional part of the golden ratio times 2**32.
GOLDEN, CIRCLE = 2_654_435_769, 1 << 32
#: Ranges of the schedule and of the hash order that are ranked apart.
SLOT_RANGE = 65_536
HASH_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """One row per source: number, source, source_size, target.

    The target is the smaller of twice the size and a common rate times the weight.  Sources
    in the order of size by weight reach their limit one after another, so the rate follows
    from running sums; all sums are whole numbers, the rate is one division.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.asc_nulls_last("source"))
    numbered = sizes.withColumn("number", F.row_number().over(everything) - 1)
    numbered = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    limit = MOST_REPEATS * F.col("source_size")
    by_need = Window.orderBy(limit / F.col("weight"), "number")
    upto, whole = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wanted = F.sum("source_size").over(whole) * share_percent / F.lit(100.0)
    rest = wanted - F.coalesce(F.sum(limit).over(upto), F.lit(0))
    rate = rest / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    # the first source, in this order, that does not reach its limit sets the rate of all after it
    settled = numbered.withColumns({"limit": limit, "rate": rate}).withColumn("free", F.col("rate") * F.col("weight") <= F.col("limit"))
    common = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "number", "rate"))).over(whole)["rate"]
    target = F.coalesce(F.least(F.col("limit").cast("double"), common * F.col("weight")), F.col("limit").cast("double"))
    return settled.select("number", "source", "source_size", target.alias("target"))


def with_blocks(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds the words to take, the number and length of blocks, and the slots that a source needs."""
    size, take = F.col("source_size"), F.col("take")
    blocks = F.greatest(F.lit(1), F.ceil(size / block_words))
    return (
        targets.withColumn("take", F.floor(F.col("target") + 0.5))
        .withColumn("length", F.greatest(F.lit(1), F.ceil(size / blocks)))
        .withColumn("blocks", F.ceil(size / F.col("length")))
        .withColumn("slots", F.when(take > 0, F.expr("take div source_size") * F.col("blocks") + F.ceil(take % size / F.col("length"))).otherwise(0).cast("long")))


def schedule(spark, sources: DataFrame) -> DataFrame:
    """The slots in the order of the mix: slot, number, rank (of the slot within its source).

    Sources own stretches of the circle in proportion to the slots they need.  Of n golden-ratio
    points no gap is wider than 1.9/n of the circle, so twice as many points as slots give every
    source all it needs; points beyond that are passed over.
    """
    total = sources.agg(F.sum("slots")).first()[0] or 0
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("slots").over(before), F.lit(0))
    bins = F.lit(max(1, min(total, 1 << 16)))
    owners = (
        sources.where("slots > 0").select("number", "slots", low.alias("low"))
        .withColumn("high", F.col("low") + F.col("slots"))
        .withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * bins / total), F.least(bins - 1, F.floor(F.col("high") * bins / total))))))
    point = F.col("slot") % (CIRCLE // 2) * GOLDEN % CIRCLE / float(CIRCLE)
    points = spark.range(2 * total).select(F.col("id").alias("slot")).withColumn("point", point * total).withColumn("bin", F.floor(F.col("point") * bins / total))
    dealt = points.join(owners, "bin").where("point >= low and point < high").select("slot", "number", "slots", F.floor(F.col("slot") / SLOT_RANGE).alias("range"))
    dealt = stored(dealt, "slots")
    counts = dealt.groupBy("number", "range").count()
    earlier = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("number", "range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("number", "range").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).join(counts, ["number", "range"]).withColumn("rank", F.col("base") + F.col("inside"))
    return ranked.where("rank < slots").select("slot", "number", "rank")


def laid_out(sized: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys as one, with their `copies`, and the place `start` on their source's axis."""
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.groupBy("number", *keys).agg(F.count("*").alias("copies")).withColumns({"order": shuffled, "length": F.col("size") * F.col("copies")})
    rows = rows.withColumn("range", F.substring("order", 1, HASH_DIGITS))
    sums = rows.groupBy("number", "range").agg(F.sum("length").alias("sum"))
    earlier = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("number", "range").orderBy("order", *(F.asc_nulls_last(k) for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
            .join(sums, ["number", "range"]).withColumn("start", F.col("base") + F.col("inside")).drop("order", "range", "inside", "base", "length"))


def taken_words(sized: DataFrame, keys: list[str], block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document copy: the keys, copy, copies, source_size, target, taken, first_slot, again_slot.

    `sized` has source, size and the keys (doc_id and size among them).  A document's slots
    are those whose block holds words of it: first_slot is the first of the schedule, and
    again_slot the first of the second time round (null where the mix takes none).
    """
    spark = sized.sparkSession
    sources = stored(with_blocks(source_targets(sized), block_words), "sources")
    numbered = sized.join(sources.select("number", F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    documents = laid_out(numbered, keys).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    documents = stored(documents.withColumn("start", F.col("start") + (F.col("copy") - 1) * F.col("size")).join(sources.drop("slots"), "number"), "layout")
    # slots meet the blocks they take
    slots = schedule(spark, sources).join(sources.select("number", "blocks", "length", F.col("source_size").alias("whole"), "take"), "number")
    block, again = F.expr("rank % blocks"), F.expr("rank div blocks")
    clip = F.least(F.expr("(rank % blocks + 1) * length"), F.col("take") - again * F.col("whole"))
    used = slots.select("number", block.alias("block"), clip.alias("clip"), "slot", again.alias("again"))
    end = F.col("start") + F.col("size") - 1
    pieces = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr("start div length"), F.floor(end / F.col("length")))))
    overlap = F.least(F.col("start") + F.col("size"), "clip") - F.greatest("start", F.col("block") * F.col("length"))
    slot = F.when(overlap > 0, F.col("slot"))
    taken = pieces.join(used, ["number", "block"]).groupBy("number", "start").agg(
        F.sum(F.greatest(overlap, F.lit(0))).alias("taken"), F.min(slot).alias("first_slot"), F.min(F.when(F.col("again") > 0, slot)).alias("again_slot"))
    # documents without words share their place with others and take nothing
    joined = documents.where("size > 0").join(taken, ["number", "start"], "left").select("source", *keys, "copy", "copies", "source_size", "target",
                                                                                               F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "again_slot")
    none = F.lit(None).cast("long")
    empty = documents.where("size = 0").select("source", *keys, "copy", "copies", "source_size", "target", F.lit(0).cast("long").alias("taken"), none.alias("first_slot"), none.alias("again_slot"))
    return joined.unionByName(empty)


def mix_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot (its place in the order of the mix; null if it has none)."""
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")), "sizes")
    return taken_words(sized, ["doc_id", "size"]).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as the mix takes it (to the nearest whole).

    Rows come in the order of the schedule: sorted by slot within and across partitions, so
    files written from them follow the weights from the first to the last.
    """
    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), content.alias("content"))
    sized = stored(rows.drop("row"), "sizes")
    keys = ["doc_id", "size", "content"]
    shares = taken_words(sized, keys).where("size > 0").groupBy("source", *keys).agg(
        F.floor(F.sum("taken") / (F.max("copies") * F.col("size")) + 0.5).alias("times"), F.min("first_slot").alias("first_slot"), F.min("again_slot").alias("again_slot"))
    shares = shares.where("times > 0").select("times", "first_slot", "again_slot", *(F.col(k).alias(f"_{k}") for k in ("source", *keys)))
    shares = stored(shares, "shares")
    last = shares.agg(F.max(F.greatest("first_slot", F.coalesce("again_slot", "first_slot")))).first()[0] or 0
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("source", *keys)]
    on = same[0] & same[1] & same[2] & same[3]
    each = rows.join(shares, on).select("row", "doc_id", "first_slot", "again_slot", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    slot = F.when(F.col("nth") > 1, F.coalesce("again_slot", "first_slot")).otherwise(F.col("first_slot"))
    # slots hold equal numbers of words, so ranges of slots make equal partitions without a sample
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = each.select("row", slot.alias("slot"), F.xxhash64("doc_id").alias("within"))
    dealt = ordered.repartitionById(parts, F.expr(f"cast(slot * {parts} div {last + 1} as int)"))
    return dealt.sortWithinPartitions("slot", "within").select("row.*")
