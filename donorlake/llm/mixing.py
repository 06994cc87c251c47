"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

A mix as large as the corpus is shared among the sources by weight. A source gives whole epochs (every document once)
while they fit, and then a part of one more: its documents get exponential keys, divided by their quality weight, are
put in the order of the keys, and are taken from the smallest key on until the words that are left to take are reached.

Keys come from a checksum of the document and a seed, so a rerun draws the same documents. The order within a source is
never made in one task: keys are cut into ranges, as many as the source has rows for, and each range is sorted alone;
what comes before a range is a sum over range totals. Ranges are cut where the keys are: how many of a source's keys lie
below a point follows from how many of its documents have which quality, so sources of poor documents have even ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from donorlake.llm.common import cut, n_words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
ROWS_PER_RANGE = 20_000
#: Qualities are told apart in steps of this size when keys are cut into ranges.
QUALITY_STEPS = 200


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of letters among the characters that aren't blank."""
    text = F.coalesce(text, F.lit(""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.when(solid > 0, 0.1 + 0.9 * letters / solid).otherwise(0.1)


def uniform(parts: list[Column], seed: int) -> Column:
    """A number in (0, 1), drawn by checksum: 52 bits of the MD5 of the parts and the seed."""
    shown = [F.coalesce(part.cast("string"), F.lit("\u0000")) for part in parts]
    digest = F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *shown).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """One row per source with ``source_size``, ``n_docs`` and ``target``, from rows of ``source`` and ``size``.

    Sources in the order of their code points, null last, get the weights in turn. A target is ``level * weight``, or
    ``most`` times the source's size where that is less; the level is such that all targets make up all sizes. Sources
    are put in the order in which they reach their limit: the level is the one that the sources from some place on
    share, after all before it took their limit, at the first place whose own limit that doesn't exceed.

    Rows are summed per source before anything is ordered, so the two windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    per = per.withColumns({"_weight": F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))})
    per = per.withColumns({"_limit": most * F.col("source_size")})
    filling = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.withColumns(
        {
            "_total": F.sum("source_size").over(everything),
            "_before": F.coalesce(F.sum("_limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_after": F.sum("_weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).withColumns({"_level": (F.col("_total") - F.col("_before")) / F.col("_after"), "_place": F.row_number().over(filling)})
    first_open = F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.struct("_place", "_level"))
    per = per.withColumns({"_shared": F.min(first_open).over(everything)["_level"]})
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_shared") * F.col("_weight"), F.col("_limit").cast("double")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def key_ranges(rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``source, quality, key`` and whatever else ``rows`` has, with ``_range``: the place of the key's range in its source.

    A key of a document of quality q lies below x with the chance ``1 - exp(-q * x)``, so the share of a source's keys
    below x is the mean of that over its documents, and x goes to the range that this share falls into. The share
    grows with the key, so ranges keep the order of the keys. What is kept of a source is its count per step of
    quality: whole numbers, the same in any rerun, and ``QUALITY_STEPS`` + 1 of them at most.
    """
    step = F.floor(F.col("quality") * QUALITY_STEPS)
    counts = rows.groupBy("source", step.alias("step")).agg(F.count("*").alias("n"))
    counts = counts.groupBy(F.col("source").alias("_s")).agg(
        F.sort_array(F.collect_list(F.struct("step", "n"))).alias("_steps"), F.sum("n").alias("_n")
    )
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("_s")))
    below = F.aggregate(
        "_steps", F.lit(0.0), lambda total, s: total + s["n"] * (1 - F.exp(-F.col("key") * (s["step"] + 0.5) / QUALITY_STEPS))
    )
    n_ranges = F.ceil(F.col("_n") / rows_per_range)
    return rows.withColumns({"_range": F.floor(below / F.col("_n") * n_ranges)}).drop("_s", "_steps", "_n")


def draw(
    docs: DataFrame,
    seed: int = 17,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MAX_EPOCHS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``doc_id, source, digest, size, source_size, target, epochs, key, taken`` for every row of ``doc_id, text, source``.

    ``size``: words of the text (null: 0). ``epochs``: how often the mix takes the document; ``taken``: words of that.
    The last document of the partial epoch is taken if more than half of it still fits, so a source misses its target
    by at most half a document. Documents without words are taken as often as their place in the order says.

    Rows that are equal in all of doc_id, text and source share a key; which of them comes first makes no difference to
    the result. Nulls count as values of their own. Other columns are ignored. No rows in, no rows out.
    """
    sizes = docs.select(
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
        quality_weight(F.col("text")).alias("quality"),
    )
    draws = -F.log(uniform([F.col("doc_id"), F.col("digest")], seed)) / F.col("quality")
    sizes = cut(sizes.withColumns({"key": draws}))
    targets = source_targets(sizes, weights, most).withColumnsRenamed({"source": "_source"})
    rows = key_ranges(sizes, rows_per_range).join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    totals = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    so_far = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("source").alias("_s"),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_words").over(so_far), F.lit(0).cast("bigint")).alias("_earlier"),
    )
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    inside = Window.partitionBy("source", "_range").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("bigint"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumns({"_before": before, "_full": full.cast("bigint")})
    left = F.col("target") - F.col("_full") * F.col("source_size")
    more = F.when((2 * F.col("_before") + F.col("size") <= 2 * left) & (left > 0), 1).otherwise(0)
    return rows.withColumns({"epochs": (F.col("_full") + more).cast("bigint")}).select(
        "doc_id",
        "source",
        "digest",
        "size",
        "source_size",
        "target",
        "epochs",
        "key",
        (F.col("epochs") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken, with the columns they came with.

    Rows equal in doc_id, source and text lie next to each other in the order and so are taken alike, but for one such
    set per source at most, in which the partial epoch ends; the rest of its copies is added from one of its rows.
    """
    key = F.md5(F.coalesce(F.col("_row.text"), F.lit("")).cast("binary"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    whole = whole.select("_row", F.col("_row.doc_id").alias("_id"), F.col("_row.source").alias("_source"), key.alias("_digest"))
    slim = docs.select("doc_id", "text", "source")
    drawn = draw(slim, seed, weights, most).groupBy("doc_id", "source", "digest")
    drawn = cut(drawn.agg(F.sum("epochs").alias("_times"), F.count("*").alias("_rows")))

    def of(chosen: DataFrame) -> DataFrame:
        same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source"))
        return whole.join(chosen, same & (F.col("_digest") == F.col("digest")))

    times = F.floor(F.col("_times") / F.col("_rows")).cast("int")
    even = of(drawn.filter(F.col("_times") >= F.col("_rows")))
    even = even.select("_row", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"))
    odd = of(drawn.filter(F.col("_times") % F.col("_rows") > 0))
    odd = odd.groupBy("_id", "_source", "_digest").agg(F.first("_row").alias("_row"), F.first(F.col("_times") % F.col("_rows")).alias("_more"))
    odd = odd.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_more").cast("int"))).alias("_copy"))
    return even.unionByName(odd).select("_row.*")
