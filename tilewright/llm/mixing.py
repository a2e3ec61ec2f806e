"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

A source's target is its weight's share of all words, at most ``cap`` times its own; what the cap cuts off goes to
the other sources by weight. Of a target, complete epochs come first: every document is taken as often as the
source fits whole. What is left is a fraction of the source, sampled without replacement: each document draws an exponential
key scaled by its quality weight, -ln(u) / w, documents go by rising key, and sizes are summed along until the budget; the
document at the edge gives the words that still fit.

The running sum of a source doesn't meet in one task: keys fall into slices of a source in order, sums run inside
a slice, and the slices' totals are summed apart. A slice is a step of the keys' distribution averaged over the ``SPREAD`` of
weights: whatever the rows' weights, from 0.05 to 1, no slice has more than some five times its even share of a source, and slices
grow in number with the table. u comes from the document's id, its text and a seed, so reruns agree.

Sources may be many: their order and running sums, too, come from ranges that are sorted apart, never from one sort of all.

Defined cases: a null text has size 0 and is taken 0 times; a source whose documents are all empty has target 0; a
null source is a source, the last; a null doc_id draws as an empty id; rows that repeat a document's id and text draw the same key and
go by size; an empty table gives an empty result; other columns of the input are ignored by ``mix`` and kept by
``repeat_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.ordering import pieces
from tilewright.llm.shared import keep, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of a source at least, and rows of the table for one more.
SLICES, SLICE_ROWS = 1024, 1 << 16
#: Weights over which a key's place in its source is averaged.
SPREAD = (1.0, 0.5, 0.2, 0.1, 0.05)
#: Documents up to which their numbers of copies (12 bytes each) are broadcast to the texts; beyond, both sides shuffle.
MAX_BROADCAST_ROWS = 400_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A document's weight: the share of its characters that are no symbols, 0.05 at least. Symbols are the ASCII signs but
    stop, comma, apostrophe and hyphen."""
    symbols = F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), r"""!"#$%&()*+/:;<=>?@[\]^_`{|}~""", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - symbols / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)))


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of a digest."""
    parts = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.sha2(parts, 256), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with columns of what the rows before each one, in this order, add up to. Ranges of rows are sorted apart; only
    their totals, a row a range, meet in one task."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranged = keep(df.repartitionByRange(pieces(df.sparkSession), *order).withColumn("range_", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range_").agg(*[F.sum(c).alias(f"{n}_") for n, c in sums.items()])
    totals = totals.select("range_", *[F.coalesce(F.sum(f"{n}_").over(before(Window.orderBy("range_"))), F.lit(0)).alias(f"{n}_") for n in sums])
    inside = before(Window.partitionBy("range_").orderBy(*order))
    placed = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return placed.join(F.broadcast(totals), "range_").select(*df.columns, *[(F.col(n) + F.col(f"{n}_")).alias(n) for n in sums])


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target; one row a source.

    With sources in order of cap * size / weight, the capped ones are the first j, and the level that all others get for
    a unit of weight is (total - what the capped have) / (weight of the rest); j is the first where the next isn't capped."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = running(s, [F.asc_nulls_last("source")], {"place": F.lit(1)})
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    s = running(s, [F.col("source_size") / F.col("w"), F.asc_nulls_last("source")], {"capped": F.col("source_size") * cap, "before": F.col("w")})
    s = keep(s, "sources")
    all_ = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("weight")).first()
    level = (F.lit(all_["total"] or 0) - F.col("capped")) / (F.lit(all_["weight"] or 0) - F.col("before"))
    found = s.agg(F.min(F.when(level * F.col("w") <= F.col("source_size") * cap, F.struct(F.col("capped").alias("c"), level.alias("l")))).alias("m")).first()["m"]
    level = F.lit(0.0 if found is None else found["l"])
    return s.select("source", "source_size", F.round(F.least((F.col("source_size") * cap).cast("double"), level * F.col("w")), 6).alias("target"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words, repeats counted) of every document row."""
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text).alias("size"), quality_weight(text).alias("w"), uniform(F.col("doc_id"), text, seed).alias("u"))
    d = d.withColumn("key", -F.log("u") / F.col("w"))
    d = keep(d.select("doc_id", "source", "size", "key"), "sized")  # texts are read once for the uses below
    n = max(SLICES, d.count() // SLICE_ROWS)
    reached = sum((F.lit(1.0) - F.exp(F.col("key") * -w) for w in SPREAD), F.lit(0.0)) / len(SPREAD)
    # A null source gets a key of its own, so that windows and joins share one partitioning.
    d = d.withColumn("slice", F.floor(reached * n).cast("int")).withColumn("mixed", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    t = targets(d.select("source", "size"), weights, cap).withColumn("mixed", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    slices = d.groupBy("mixed", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("mixed").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("ahead", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).drop("slice_size").join(t, "mixed")
    here = Window.partitionBy("mixed", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(here), F.lit(0))).join(slices, ["mixed", "slice"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("ahead") - F.col("inside")))
    return d.select("doc_id", "size", "source", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix as documents: each row as often as it is taken, the one at the edge of a source's budget if at least half of it fits.
    Empty documents, which no budget counts, stay once. All columns stay."""
    copies, each, id_ = unused(docs, "copies"), unused(docs, "each_copy"), unused(docs, "mixed_id")
    count = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).cast("int")
    rows = keep(mix(docs, seed).select("doc_id", "source", "size", count.alias(copies)), "copies")
    twice = keep(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(id_)), "twice")
    own = F.col("doc_id").cast("long")
    wanted = rows.select(F.col("doc_id").alias(id_), copies)
    if twice.isEmpty():
        joined = docs.join(F.broadcast(wanted) if rows.count() <= MAX_BROADCAST_ROWS else wanted, own == F.col(id_))
    else:  # rows of null or repeated ids are paired off by their rank inside the id, the source and the size
        same = lambda df, c: df[c].eqNullSafe(twice[id_])
        joined = docs.join(wanted.join(twice, id_, "left_anti"), own == F.col(id_))
        rank, size = unused(docs, "mixed_rank"), unused(docs, "mixed_size")
        a = docs.withColumn(id_ + "_", own)
        a = a.join(twice, same(a, id_ + "_"), "left_semi").withColumn(size, word_count(F.col("text").cast("string")))
        a = a.withColumn(rank, F.row_number().over(Window.partitionBy(id_ + "_", F.col("source").cast("string"), size).orderBy("text")))
        b = rows.join(twice, same(rows, "doc_id"), "left_semi")
        b = b.withColumn("rank_", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.desc(copies))))
        b = b.select(F.col("doc_id").alias("id_"), F.col("source").alias("source_"), F.col("size").alias("size_"), "rank_", copies)
        on = a[id_ + "_"].eqNullSafe(b["id_"]) & a["source"].cast("string").eqNullSafe(b["source_"]) & (a[size] == b["size_"]) & (a[rank] == b["rank_"])
        pairs = a.join(b, on).select(*[a[c] for c in docs.columns], b[copies])
        joined = joined.select(*[docs[c] for c in docs.columns], copies).unionByName(pairs)
    joined = joined.where(F.col(copies) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
