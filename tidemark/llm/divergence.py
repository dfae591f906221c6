"""How the sources of each language differ in their use of terms: between sources, and by term from the language.

Counts of terms meet as cells: terms of a group that have the same count there and in the language are one cell
with a multiplicity, the divergence is computed once for each cell, cells are ranked by cumulative multiplicity, and
only the cells within the rank limit are expanded to terms.  All numbers are integers; nothing is rounded.

Null texts, languages and sources are read as ''.  Repeated rows count as often as they occur, ids are not read, and
an empty table gives no rows.  Texts of any length are counted whole.  A language or source may hold most rows:
counts combine map-side by term, and work on pairs of sources is dealt out in slices of `SLICE` sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut, drop

# What separates terms, the share that stands for one, and letters that are lowered.
BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WHOLE = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_DOCS = 10
RANKS = 10
SLICE = 256


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats; an empty one may be first or last where the text has none there."""
    return F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1)


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """`lang, source, term, n, docs`: occurrences, and documents with the term; the texts are read once."""
    read = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    )
    words = read.select("lang", "source", terms(F.col("text")).alias("w"))
    # Each occurrence is a row, and each different term of a document another: both sums combine map-side.
    both = words.select("lang", "source", F.size("w").alias("k"), F.posexplode(F.concat("w", F.array_distinct("w"))).alias("at", "term"))
    occurs = F.col("at") < F.col("k")
    rows = both.where("term <> ''").select("lang", "source", "term", F.when(occurs, 1).otherwise(0).alias("n"), F.when(occurs, 0).otherwise(1).alias("docs"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + 2) / (total + 2 * kept)), in decimals so that no count overflows."""
    wide = "decimal(28,0)"
    over = F.lit(WHOLE).cast("decimal(10,0)") * (n + F.lit(2)).cast(wide)
    # Without kept terms there is nothing to share; the number is then used for no term.
    under = F.greatest(total + F.lit(2) * kept, F.lit(1)).cast(wide)
    return F.lit(1) + F.call_function("div", over, under)


def _apart(p: Column, q: Column) -> Column:
    """The divergence of two shares; its square is below 2^63, as shares are at most WHOLE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _ranked(values: DataFrame, part: str) -> DataFrame:
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(place).alias("rank"))


def _by_term(counts: DataFrame, cells: DataFrame, ranks: int) -> DataFrame:
    """The `ranks` terms of each group with the largest divergence from the language among those it uses more."""
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    merged = cells.where("p > q").groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    # Every value has a term at least, so no more than `ranks` values are wanted; then their terms are counted.
    best = merged.withColumn("_r", F.row_number().over(group)).where(F.col("_r") <= ranks)
    before = F.coalesce(F.sum("m").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumn("before", before).where(F.col("before") < ranks).select("lang", "source", "value", "before")
    wanted = cells.where("p > q").join(best, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value", "before")
    place = Window.partitionBy("lang", "source", "value").orderBy("item")
    found = (
        counts.join(wanted, ["lang", "source", "n", "lang_n"])
        .select("lang", "source", "value", "before", F.col("term").alias("item"))
        .withColumn("_r", F.row_number().over(place))
        .where(F.col("_r") <= ranks)
        .withColumn("rank", (F.col("before") + F.col("_r")).cast("int"))
        .where(F.col("rank") <= ranks)
    )
    return found.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _by_pair(counts: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of every two sources of a language, summed over all kept terms.

    Terms that one of the two lacks need no join: their sums follow from how many terms have each count in a source,
    set against the other's share at count zero.  Only terms that both have meet, and there as cells of two counts.
    """
    slices = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SLICE))).cast("int").alias("slices"))
    deal = F.pmod(F.xxhash64("source"), F.col("slices")).cast("int")
    # Each slice of a language's sources meets all its sources: no task has more than SLICE times them.
    mine = counts.join(slices, "lang").select("lang", "term", deal.alias("slice"), F.col("source").alias("a"), F.col("n").alias("na"))
    other = counts.join(slices, "lang").select(
        "lang", "term", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("source").alias("b"), F.col("n").alias("nb")
    )
    both = mine.join(other, ["lang", "term", "slice"]).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("m"))
    a = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), F.col("zero").alias("za"), "kept")
    b = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("tb"), F.col("zero").alias("zb"))
    both = both.join(a, ["lang", "a"]).join(b, ["lang", "b"])
    p, q = _share(F.col("na"), F.col("ta"), F.col("kept")), _share(F.col("nb"), F.col("tb"), F.col("kept"))
    both = both.select("lang", "a", "b", "m", "za", "zb", p.alias("p"), q.alias("q"))
    more = _apart(F.col("p"), F.col("q")) - _apart(F.col("p"), F.col("zb")) - _apart(F.col("za"), F.col("q")) + _apart(F.col("za"), F.col("zb"))
    met = both.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * more).alias("v"))

    # How many terms have each count in a source, those that it lacks with count zero; so every source has a row.
    used = cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m"), F.first("p").alias("p"))
    unused = groups.select("lang", "source", F.lit(0).cast("bigint").alias("n"), (F.col("kept") - F.col("own")).alias("m"), F.col("zero").alias("p"))
    spread = used.unionByName(unused).join(slices, "lang").withColumn("slice", deal).drop("slices")
    others = groups.join(slices, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("source").alias("b"), "zero", "kept"
    )
    against = spread.join(others, ["lang", "slice"]).where("source <> b")
    sided = against.groupBy("lang", F.col("source").alias("a"), "b").agg(
        F.sum(F.col("m") * _apart(F.col("p"), F.col("zero"))).alias("v"),
        # Terms that both lack are in both sides' sums.
        F.sum(F.when(F.col("n") == 0, F.col("kept") * _apart(F.col("p"), F.col("zero"))).otherwise(0)).alias("twice"),
    )
    turned = [F.col("b").alias("a"), F.col("a").alias("b")]
    parts = (
        sided.select("lang", "a", "b", (F.col("v") - F.col("twice")).alias("v"))
        .unionByName(sided.select("lang", *turned, "v"))
        .unionByName(met)
        .unionByName(met.select("lang", *turned, "v"))
    )
    values = parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("v").alias("value"))
    return _ranked(values, "pair")


def divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, ranks: int = RANKS
) -> DataFrame:
    """`lang, source, part, item, value, rank`: `pair` rows compare a source with each other of its language over all
    terms that `min_docs` documents of the language have; `term` rows are the `ranks` terms by which it departs most
    from its language, among those it uses more.  Equal values are ordered by item."""
    all_counts = cut(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = all_counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    counts = cut(all_counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    drop(all_counts)
    # Each term once for its language: the counts of its sources sum to it.
    langs = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total")
    )
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    groups = names.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0)
    groups = cut(groups.withColumn("zero", _share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept"))), "groups")
    cells = counts.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m")).join(groups, ["lang", "source"])
    cells = cells.select(
        "lang", "source", "n", "lang_n", "m",
        _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    cells = cut(cells.withColumn("value", _apart(F.col("p"), F.col("q"))), "cells")
    return _by_pair(counts, cells, groups).unionByName(_by_term(counts, cells, ranks))
