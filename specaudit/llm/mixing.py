"""Mixing sources to target weights by a low-discrepancy schedule [native].

Sources share ``share`` times all words by weight; no source's target is above ``most`` times its size, and what a
capped source leaves is shared again.  A source is a stream of its documents in an order drawn by hash, read again from
its start where it ends, and cut into blocks of ``block`` words.  Slot ``i`` of the schedule has the point
``frac(i * g)``, ``g`` the golden ratio's fraction; the source in whose interval of the cumulative targets the point
lies gives its next block.  So every stretch of the mix holds the sources in proportion.

Slots are ranked within their source and joined with the blocks of that rank.  A source's quota is its target in
whole words: a slot beyond it is left out, the last block is as short as the quota asks, and the few blocks that the schedule still
owes when it ends (its discrepancy, about log2 of its length a source) follow in turns of the sources.

Nothing here needs a source in one place.  Documents are summed by source and one of ``BUCKETS`` ranges of the hash, slots by source
and stretch of the schedule, and points meet intervals cell by cell, where each cell holds as many points as any other.

Defined cases: a null text, an empty one and one of white space have no words and are never taken; null is a source
of its own, the last; repeated rows are documents of their own, and rows that share an id
are put in order by size, so reruns agree on all rows; very long texts are counted without a list of their words and span many blocks;
sources without a word have target 0; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.llm.common import discard, materialize
from specaudit.llm.ranking import ordered, running_total, with_rank

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Words of a block.
BLOCK = 1024
#: Ranges of the hash, 12 bits of it.
BUCKETS = 4096
#: Slots of a stretch of the schedule, and about as many points stand in a cell.
STRETCH = 1 << 16
GOLDEN = 0.6180339887498949
SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Words between ASCII white space, counted in the JVM without making a list of them."""
    bare = F.ltrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(bare, f"[^{SPACE}]++[{SPACE}]*+", "x")).cast("long")


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = df.select(F.monotonically_increasing_id().alias("rid"), df[id_col].cast("long").alias("doc_id"), df[source_col].cast("string").alias("source"), word_count(df[text_col]).alias("size"))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumns({"skey": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")), "place": F.substring(place, 1, 16)})
    return materialize(rows.withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")), "mixing-sizes")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``skey, source, source_size`` with ``sid`` (place by code point, null last), ``target`` and ``quota``.

    Each round caps the sources that their weight's share would overfill and shares the rest again, two sums a round.
    """
    table = with_rank(ordered(sources, F.col("source").asc_nulls_last(), label="mixing-sources"), "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    table = materialize(table.withColumn("weight", weight.cast("long")), "mixing-sources")
    want = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    cap = most * F.col("source_size")
    level = 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        capped, free = table.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        after = (want - capped) / free if free else level
        if after <= level:
            break
        level = after
    target = F.when(full, cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return table.withColumn("target", target).withColumn("quota", F.least(cap, F.round("target").cast("long")))


def schedule(spark, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, sid, rank``: which source's which block stands where; ``shares`` has ``sid`` and ``quota``."""
    total = shares.agg(F.sum("quota")).first()[0] or 0
    slots = ceil(total / block)
    cells = max(1, slots // STRETCH)
    # a product with the number of a stretch and one with the place in it keep all digits of the fraction, however long the schedule is
    stretch, place = F.expr(f"slot div {STRETCH}"), F.col("slot") % STRETCH
    step = STRETCH * GOLDEN % 1
    far = stretch * F.lit(step)
    point = far - F.floor(far) + place * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot")).select("slot", (point - F.floor(point)).alias("x"), F.lit(None).cast("long").alias("sid"))
    points = points.withColumn("cell", F.least(F.floor(F.col("x") * cells), F.lit(cells - 1)).cast("long"))
    # cumulative targets in whole words, so that one interval ends exactly where the next begins
    given = with_total(shares.where("quota > 0"), "quota")
    given = given.select("sid", (F.col("before") / F.lit(max(1, total))).alias("low"), ((F.col("before") + F.col("quota")) / F.lit(max(1, total))).alias("high"))
    none = F.lit(None).cast("long").alias("slot")
    starts = given.select(none, F.col("low").alias("x"), "sid", F.floor(F.col("low") * cells).cast("long").alias("cell"))
    edge = given.select("sid", F.ceil(F.col("low") * cells).cast("long").alias("a"), (F.ceil(F.col("high") * cells) - 1).cast("long").alias("b")).where("a <= b")
    edges = edge.select(none, F.lit(-1.0).alias("x"), "sid", F.explode(F.sequence("a", "b")).alias("cell"))
    carried = Window.partitionBy("cell").orderBy("x", F.col("slot").asc_nulls_first(), "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = points.unionByName(starts).unionByName(edges).withColumn("sid", F.last("sid", ignorenulls=True).over(carried)).where("slot is not null")
    ranked = running_total(drawn.select("slot", "sid", F.expr(f"slot div {STRETCH}").alias("stretch")), F.lit(1), ["sid"], "stretch", F.col("slot"))
    ranked = materialize(ranked.select("slot", "sid", F.col("before").alias("rank")), "mixing-slots")
    # what the schedule owes when it ends
    had = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
    due = shares.select("sid", F.ceil(F.col("quota") / block).cast("long").alias("due")).where("due > 0")
    owed = due.join(had, "sid", "left").select("sid", "due", F.coalesce("had", F.lit(0)).alias("had")).where("had < due")
    turns = shares.agg(F.max("sid")).first()[0] or 0
    rest = owed.select("sid", F.posexplode(F.sequence("had", F.col("due") - 1)).alias("turn", "rank"))
    rest = rest.select((F.lit(slots) + F.col("turn") * (turns + 1) + F.col("sid")).alias("slot"), "sid", "rank")
    return ranked.join(due, "sid").where("rank < due").select("slot", "sid", "rank").unionByName(rest)


def with_total(shares: DataFrame, measure: str) -> DataFrame:
    """``shares`` with ``before``, the sum of a measure over all smaller ``sid``."""
    rows = shares.withColumn("__all", F.lit(0)).withColumn("__chunk", F.expr(f"sid div {STRETCH}"))
    return running_total(rows, F.col(measure), ["__all"], "__chunk", F.col("sid")).drop("__all", "__chunk")


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = 12) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: ``rid, doc_id, size, source_size, target``.  pieces: ``slot, at, rid, doc_id, first, words``: the mix in order of
    (slot, at) takes ``words`` words of the document from its word ``first`` on.
    """
    sizes = _sizes(df, id_col, text_col, source_col, seed)
    sources = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    shares = materialize(targets(sources, weights, share, most), "mixing-targets")
    # all that a bucket of a source has in common comes with the bucket's own row, so no join has a source for its key
    placed = running_total(sizes, F.col("size"), ["skey"], "bucket", F.col("place"), F.col("doc_id").asc_nulls_last(), F.col("size"))
    about = sizes.select("skey", "bucket").distinct().join(shares.select("skey", "sid", "source_size", "target", "quota"), "skey")
    documents = materialize(placed.join(about, ["skey", "bucket"]).select("rid", "doc_id", "size", "sid", "before", "source_size", "target", "quota"), "mixing-documents")
    start = F.col("before") + F.col("turn") * F.col("source_size")
    turns = documents.where("size > 0").withColumn("turn", F.explode(F.array(*(F.lit(t) for t in range(most))))).withColumn("start", start).withColumn("end", F.least(start + F.col("size"), "quota")).where("start < end")
    cut = turns.withColumn("rank", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))))
    low, high = F.greatest("start", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    cut = cut.select("sid", "rank", "rid", "doc_id", (low - F.col("rank") * block).alias("at"), (low - F.col("start")).alias("first"), (high - low).alias("words"))
    slots = materialize(schedule(df.sparkSession, shares, block), "mixing-schedule")
    pieces = cut.join(slots, ["sid", "rank"]).select("slot", "at", "rid", "doc_id", "first", "words")
    discard(sizes)
    return documents, pieces


def mixed(df: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    documents, pieces = mixture(df, **options)
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def block_texts(df: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``slot, text``: the words of each block of a mixture, for tables whose ids are unique."""
    words = F.regexp_extract_all(F.coalesce(df[text_col].cast("string"), F.lit("")), F.lit(f"[^{SPACE}]+"), F.lit(0))
    texts = df.select(df[id_col].cast("long").alias("doc_id"), words.alias("ws"))
    own = pieces.join(texts, "doc_id").select("slot", "at", F.expr("slice(ws, int(first) + 1, int(words))").alias("ws"))
    return own.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("at", "ws"))).alias("parts")).select("slot", F.array_join(F.flatten("parts.ws"), " ").alias("text"))
