"""Mix sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end on a line of words, which
is cut into blocks of equally many words and, if the target asks for more words than there
are, run through again. Points of the golden-ratio sequence, mapped through the cumulative
block shares, give the order in which sources provide their next block; the rank of a point
among its source's points is the number of the block. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_keys, one_row, running_sum, stored, text_of

#: Weights in the order of the sources' code points (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and how often it may take a document.
TOTAL, REPEATS = 1.5, 2
#: Words in a block.
BLOCK = 4096
#: Documents are shuffled into so many buckets per source, if it has this share of all rows (so at most 1 / SHARE sources have
#: buckets; any other fits a task), and points into chunks of so many.
BUCKETS, SHARE, CHUNK = 4096, 0.002, 4096
#: Cells of [0, 1) by which points find their source's interval.
CELLS = 4096
#: 2 ** 32 over the golden ratio, odd: multiples modulo 2 ** 32 are the points.
GOLDEN, SPAN = 2654435769, 1 << 32


def targets(sizes: DataFrame) -> DataFrame:
    """skey, source_size, target, buckets per source of sizes (skey, size), by water filling.

    Targets are min(REPEATS * source_size, level * weight) where the level makes them sum up to
    TOTAL of all words: in order of room per weight, a source is full if the level that is left
    for it and all after it exceeds its room. One row per source goes through the windows.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("room", F.col("source_size") * float(REPEATS))
    order = [F.col("room") / F.col("weight"), F.col("skey")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * TOTAL - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weights).withColumn("full", F.col("room") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(order[0].alias("o"), F.col("skey").alias("k"), F.col("level").alias("l")))).over(everything)
    return per.withColumn("level", level["l"]).select(
        "skey", "source_size", F.when(F.col("full"), F.col("room")).otherwise(F.col("weight") * F.col("level")).alias("target"),
        F.when(F.col("rows") >= F.sum("rows").over(everything) * SHARE, F.lit(BUCKETS)).otherwise(1).alias("buckets"),
    )


def source_key() -> Column:
    """The source as a key that is never null and sorts null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """skey, block, slot: the point at which each source provides its block-th block.

    sources: skey, blocks (number of slots the source has). Points beyond a source's number of
    blocks are unused; a source whose last blocks got no point is left to mix() to put at the end.
    """
    all_ = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = sources.where("blocks > 0").select(
        "skey", "blocks",
        ((F.sum("blocks").over(upto) - F.col("blocks")) / F.sum("blocks").over(all_)).alias("lo"),
        (F.sum("blocks").over(upto) / F.sum("blocks").over(all_)).alias("hi"),
    )
    last = F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS))
    span = span.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), last)))
    points = sources.sparkSession.range(slots).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"), (F.pmod(F.pmod("id", F.lit(SPAN)) * F.lit(GOLDEN), F.lit(SPAN)) / F.lit(float(SPAN))).alias("u")
    )
    hits = points.withColumn("cell", F.floor(F.col("u") * CELLS)).join(span, "cell").where("u >= lo and u < hi")
    ranked = running_sum(hits, "skey", "chunk", ["slot"], F.lit(1), "block")
    return ranked.where("block < blocks").select("skey", "block", "slot")


def mix(docs: DataFrame, seed: int = 9) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, skey, size, source_size, target, taken, first_slot.

    skey is the source's key (see source_key()), size is the number of words (null text: 0), source_size and target belong to the source
    (a null source is one of its own). taken counts the words that the mix takes, repeats
    included: over a source they sum up to the whole part of its target. first_slot is the
    earliest slot that takes some of the document (null if none does). Repeated rows are
    documents of their own. Order and result depend only on the rows and the seed.
    """
    sized = docs.select(
        "doc_id",
        source_key().alias("skey"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_of()).alias("text_hash"),
    )
    sized = stored(sized, "mix-sizes")  # the texts are read once
    plan = stored(targets(sized).withColumn("take", F.floor("target")).withColumn("blocks", F.ceil(F.col("take") / BLOCK)), "mix-targets")
    slots = int(plan.agg(F.sum("blocks")).first()[0] or 0)
    slots += slots // 64 + 64
    large = plan.where("buckets > 1").select("skey", "buckets")  # 1 / SHARE rows at most
    shuffled = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash")).join(F.broadcast(large), "skey", "left")
    shuffled = shuffled.withColumn("bucket", F.pmod("h", F.coalesce("buckets", F.lit(1)))).drop("buckets")
    line = running_sum(shuffled, "skey", "bucket", ["h", "doc_id", "text_hash"], F.col("size"), "start")
    # the source's figures travel by (source, bucket), so that a hot source is spread
    spread = plan.select("skey", "source_size", "target", "take", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets").cast("long") - 1)).alias("bucket"))
    line = line.join(spread.hint("merge"), ["skey", "bucket"])
    nth = F.row_number().over(Window.partitionBy("skey", "bucket").orderBy("start", "size", "doc_id", "text_hash"))
    line = line.withColumn("nth", nth)
    passes = line.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    passes = passes.withColumn("a", F.col("start") + F.col("run") * F.col("source_size"))
    passes = passes.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("take"))).where("b > a")
    pieces = passes.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("b") - 1) / BLOCK))))
    words = F.least(F.col("b"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("a"), F.col("block") * BLOCK)
    at = schedule(plan, slots)
    pieces = pieces.select("skey", "bucket", "nth", "block", words.alias("words")).join(at, ["skey", "block"], "left")
    slot = F.coalesce("slot", F.lit(slots) + F.col("block"))
    taken = pieces.groupBy("skey", "bucket", "nth").agg(F.sum("words").alias("taken"), F.min(slot).alias("first_slot"))
    return line.join(taken, ["skey", "bucket", "nth"], "left").select(
        "doc_id", "text_hash", "skey", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )


def mixed_documents(docs: DataFrame, seed: int = 9) -> DataFrame:
    """The mix itself: rows of docs with all their columns, as often as they are taken.

    A document taken in part (one per source at most) keeps its first words, with the white
    space before each; n_chars, if there is one, follows. Rows equal in id, text and source are
    one document that is there several times, with the other columns of one of them (see
    one_row()). Texts are shuffled once.
    """
    keys = ["none", "id", "text_hash", "skey"]
    got = mix(docs.select("doc_id", "text", "source"), seed).where("taken > 0")
    # how often each amount is taken: at most REPEATS + 1 amounts for equal rows, and one in part for each source
    got = got.select(*id_keys(), "text_hash", "skey", "taken", "size").groupBy(*keys, "taken", "size").agg(F.count("*").alias("times"))
    rows = one_row(docs, *id_keys(), F.xxhash64(text_of()).alias("text_hash"), source_key().alias("skey"))
    part = F.pmod("taken", "size")
    whole = F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    wanted = F.concat(whole, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = rows.join(got.hint("merge"), keys).withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).withColumn("first", F.explode(wanted))
    words = F.regexp_extract_all("row.text", F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    out = out.select("row", "first", F.when(F.col("first") < 0, F.col("row.text")).otherwise(F.array_join(F.slice(words, 1, F.col("first").cast("int")), "")).alias("cut"))
    changed = {"text": F.col("cut"), "n_chars": F.when(F.col("first") < 0, F.col("row.n_chars")).otherwise(F.char_length("cut").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
