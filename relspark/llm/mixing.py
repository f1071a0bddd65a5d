"""Mixing sources to target weights by Pareto order sampling. Only DataFrame functions; no Python on the executors.

Each source gets a target number of words. A source whose target is ``rate`` times its size gives ``floor(rate)`` certain copies
of each document; the words left are filled by a sample without replacement in which documents have unequal inclusion probabilities:
``p`` is in proportion to a weight that grows as the root of the document's size (``weight``: a power of two for each two
bits of the size), such that the expected words meet the need. Documents for which that would reach 1 are certain and leave the sample. The
others are ranked by ``(u / (1 - u)) / (p / (1 - p))``, ``u`` being a repeatable uniform draw for the doc_id, and taken in that
order up to the words that are left (the sample's fixed size; the last document is taken if that comes nearer).

The order is never sorted as a whole: rank keys fall into buckets, whose number follows the rows, words are summed by source and bucket, prefix sums over
these sums find the one bucket in which a source's sample ends, and only that bucket's rows are sorted. What comes out is a
cut per source, a small table, so the texts are filtered in place and never shuffled. Only tables of one row a source (or source and weight, or source and bucket)
are ever sorted by one key.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; null doc_ids draw as the empty
string; rows with the same doc_id, source and weight are taken or left together; an empty table gives an empty result; a source
of size 0 has target 0 and none of its documents is taken. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relspark.llm.common import by_place, checkpoint, maybe_broadcast, named_again, placed, uniform

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rows that a bucket of rank keys holds, about; there are BUCKETS at least.
BUCKETS, BUCKET_ROWS = 1024, 50_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``sizes``: _mix_key, size. One row per source: _mix_key, source_size, target.

    Sources in key order weigh ``weights``, repeating. Together they get share[0]/share[1] of all words. Filling stops at
    ``most`` times a source's size: in order of size by weight, a source is full if the level at which the sources not
    before it would share what is left reaches its bound. The comparison is in whole numbers, so exact.
    """
    by = sizes.groupBy("_mix_key").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy("_mix_key")) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("_w"), "_mix_key").rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: c.cast("decimal(38,0)")
    by = by.withColumn("_w", w.cast("long"))
    by = by.withColumns({"_all": F.sum("source_size").over(whole), "_ws": F.sum("_w").over(whole), "_size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "_w_before": F.coalesce(F.sum("_w").over(before), F.lit(0))})
    num, den = share
    left = num * big(F.col("_all")) - den * most * big(F.col("_size_before"))
    by = by.withColumn("_full", left * F.col("_w") >= den * most * big(F.col("source_size")) * (F.col("_ws") - F.col("_w_before")))
    by = by.withColumns({"_full_size": F.sum(F.when(F.col("_full"), F.col("source_size")).otherwise(0)).over(whole), "_full_w": F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0)).over(whole)})
    open_target = (F.col("_w") * (num * F.col("_all") - den * most * F.col("_full_size"))).cast("double") / (den * (F.col("_ws") - F.col("_full_w"))).cast("double")
    return by.select("_mix_key", "source_size", F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(open_target).alias("target"))


def weight(size: Column) -> Column:
    """A power of two that grows as the root of the size: 1 for no words, 2 for 1 to 3, 4 for 4 to 15, and so on."""
    bits = F.when(size > 0, F.length(F.bin(size))).otherwise(0)
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.floor((bits + 1) / 2).cast("int"))


def _rank(u: Column, p: Column) -> Column:
    """Random odds by inclusion odds, mapped to [0, 1) by x / (1 + x)."""
    x = F.try_divide(u / (1.0 - u), p / (1.0 - p))  # null if p is 0
    return x / (1.0 + x)


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``sizes``: _mix_key, size. One row per source: targets and _mix_whole (certain copies of all its documents), _mix_full (the least weight whose documents
    have one more for certain), _mix_c (p by weight, of the others) and _mix_need (words that the others are to give)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.withColumn("_mix_whole", F.floor(rate)).withColumn("_need", F.col("target") - F.col("_mix_whole") * F.col("source_size"))
    by = sizes.groupBy("_mix_key", weight(F.col("size")).alias("_w")).agg(F.sum("size").alias("_words")).join(rates.select("_mix_key", "_need"), "_mix_key")
    big = F.col("_w").cast("decimal(18,0)") * F.col("_words").cast("decimal(19,0)")
    heavy = Window.partitionBy("_mix_key").orderBy(F.desc("_w"))
    before = F.coalesce(F.sum("_words").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    left = F.sum(big).over(heavy.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    by = by.withColumn("_full", (F.col("_words") > 0) & (F.col("_need") > 0) & ((F.col("_need") - before) * F.col("_w") >= left))
    shares = by.groupBy("_mix_key").agg(F.min(F.when(F.col("_full"), F.col("_w"))).alias("_mix_full"), F.coalesce(F.sum(F.when(F.col("_full"), F.col("_words"))), F.lit(0)).alias("_taken"), F.sum(F.when(~F.col("_full"), big)).alias("_open"))
    out = rates.join(shares, "_mix_key").withColumn("_mix_need", F.col("_need") - F.col("_taken"))
    return out.withColumn("_mix_c", F.coalesce(F.try_divide(F.col("_mix_need"), F.col("_open").cast("double")), F.lit(0.0))).drop("_need", "_taken", "_open")


def _open(w: Column) -> Column:
    """Whether the sample decides about a document of that weight, its source's rates being at hand."""
    return (F.col("_mix_c") > 0) & (F.col("_mix_full").isNull() | (w < F.col("_mix_full")))


def source_cuts(sizes: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """``sizes``: doc_id, _mix_key, size. One row per source: its rates, and the last rank and doc_id that the sample takes."""
    rates = checkpoint(source_rates(sizes, targets))
    buckets = max(BUCKETS, 1 << (sizes.count() // BUCKET_ROWS).bit_length())
    ranked = sizes.join(maybe_broadcast(rates.filter("_mix_c > 0").select("_mix_key", "_mix_c", "_mix_full", "_mix_need")), "_mix_key").withColumns({"_w": weight(F.col("size")), "_u": uniform(seed, F.col("doc_id"))}).filter(_open(F.col("_w")))
    ranked = ranked.withColumn("_rank", _rank(F.col("_u"), F.col("_mix_c") * F.col("_w"))).withColumn("_bucket", F.floor(F.col("_rank") * buckets))
    sums = ranked.groupBy("_mix_key", "_bucket").agg(F.sum("size").alias("_words"), F.first("_mix_need").alias("_need"))
    upto = F.sum("_words").over(Window.partitionBy("_mix_key").orderBy("_bucket"))
    sums = sums.withColumn("_before", upto - F.col("_words"))
    # The bucket in which the need is met; if rounding leaves the need above all words, the last one.
    last = sums.filter(F.col("_before") <= F.col("_need")).groupBy("_mix_key").agg(F.max_by(F.struct("_bucket", "_before"), "_bucket").alias("_end"))
    last = maybe_broadcast(checkpoint(last.select("_mix_key", F.col("_end._bucket").alias("_bucket"), F.col("_end._before").alias("_before"))))
    rows = ranked.join(last, ["_mix_key", "_bucket"]).groupBy("_mix_key", "_rank", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")).agg(F.sum("size").alias("_words"), F.first("_mix_need").alias("_need"), F.first("_before").alias("_before"))
    cum = F.col("_before") + F.sum("_words").over(Window.partitionBy("_mix_key").orderBy("_rank", "_id").rowsBetween(Window.unboundedPreceding, 0))
    inside = rows.withColumn("_cum", cum).filter(2 * F.col("_cum") - F.col("_words") <= 2 * F.col("_need"))
    ends = inside.groupBy("_mix_key").agg(F.max(F.struct("_rank", "_id")).alias("_mix_end"))
    # Where no row of the last bucket is taken, the buckets before it are.
    return rates.join(last.select("_mix_key", F.col("_bucket").alias("_mix_bucket")), "_mix_key", "left").join(ends, "_mix_key", "left").withColumn("_mix_buckets", F.lit(buckets))


def with_copies(rows: DataFrame, doc_id: Column, size: Column, seed: str) -> DataFrame:
    """``rows``, which have their source's cut, with _mix_n, how often each is taken. Draw, rank and weight are columns of their own, so each is computed once a row."""
    rows = rows.withColumns({"_mix_w": weight(size), "_mix_u": uniform(seed, doc_id), "_mix_id": F.coalesce(doc_id.cast("string"), F.lit(""))})
    rows = rows.withColumn("_mix_rank", _rank(F.col("_mix_u"), F.col("_mix_c") * F.col("_mix_w")))
    bucket, end, rank = F.floor(F.col("_mix_rank") * F.col("_mix_buckets")), F.col("_mix_end"), F.col("_mix_rank")
    hit = (bucket < F.col("_mix_bucket")) | ((bucket == F.col("_mix_bucket")) & end.isNotNull() & ((rank < end["_rank"]) | ((rank == end["_rank"]) & (F.col("_mix_id") <= end["_id"]))))
    more = F.when(F.coalesce(F.col("_mix_w") >= F.col("_mix_full"), F.lit(False)), 1).when(_open(F.col("_mix_w")) & F.coalesce(hit, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("_mix_n", (F.col("_mix_whole") + more).cast("long"))


def plan_mix(docs: DataFrame, *, weights=WEIGHTS, share=(3, 2), most: int = 2, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Read the texts once for their sizes. Returns (sizes: doc_id, source, _mix_key, size; cuts: one row per source)."""
    sizes = checkpoint(docs.select("doc_id", "source", source_key(F.col("source")).alias("_mix_key"), word_count(F.col("text")).alias("size")))
    return sizes, checkpoint(source_cuts(sizes, source_targets(sizes, weights, share, most), seed))


def mix_sizes(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies, taken (words, repeats counted)."""
    sizes, cuts = plan_mix(docs, **how)
    out = with_copies(sizes.join(maybe_broadcast(cuts), "_mix_key"), F.col("doc_id"), F.col("size"), how.get("seed", SEED)).withColumnRenamed("_mix_n", "copies")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns. Texts stay in their partitions."""
    _, cuts = plan_mix(docs, **how)
    doc_id, source, text = (F.col(placed(docs, c)) for c in ("doc_id", "source", "text"))
    # Words are counted once a row: each step refers to columns of the one before, and no filter is there to be pushed below them.
    keyed = by_place(docs).withColumns({"_mix_key": source_key(source), "_mix_size": word_count(text)})
    copies = with_copies(keyed.join(maybe_broadcast(cuts), "_mix_key"), doc_id, F.col("_mix_size"), how.get("seed", SEED))
    return named_again(copies.withColumn("_mix_i", F.explode(F.array_repeat(F.lit(0), F.col("_mix_n").cast("int")))), docs)
