"""Spelling variants: words one edit apart, found by an index of grams of variable length.

A gram is extended while it is frequent, so the dictionary holds short rare grams and long ones where short ones
are common.  Every place of a word gives the gram that starts there.  One edit changes no more grams than cover one
letter of the word; that count bounds how few grams a variant shares, so only as many of a word's rarest grams
need be looked up, and pairs that meet there are verified by their edit distance.

Words are taken as they are; null, empty and repeated words have no place in a table of counts, and `variants` joins
none of them (repeats are summed).  An empty table gives no rows, words below `MIN_LETTERS` are refused, words of
any length are compared whole.  Words beyond LONG letters, for which a row for each place would grow with the square of the
length, are looked up by their halves instead: an edit leaves one of them as it is.  A word that very many others are near to is only ever counted map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut, drop

# What a run of letters is, and the letters that are lowered.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_LETTERS = 6
SHORTEST, LONGEST = 2, 6
LONG = 128
# A gram in more places is extended; one that is full length and in more places than CROWDED has its list split.
FREQUENT = 32
CROWDED = 256
RATIO = 5


def runs(text: Column, least: int) -> Column:
    """All maximal runs of at least `least` letters, lowered."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"{RUN[:-1]}{{{least},}}"), F.lit(0))


def without_letter(word: Column, at: Column) -> Column:
    """A word without the letter at a place counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + F.lit(2), F.length(word)))


def grams(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """`word, n, place, gram, freq`: for each place of each word between its marks, the shortest gram that is in no
    more than `frequent` places, or the longest there is.

    The grams that are extended are the inner nodes of the gram dictionary; the trie is walked by all places at
    once, a level by a count and a join.  Whether a walk goes on depends on the gram alone, not on what follows.
    """
    marked = words.select("word", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("m"))
    walking = marked.select(
        "word", "n", "m", F.explode(F.sequence(F.lit(0), F.length("m") - SHORTEST)).alias("place")
    )
    done, written = None, []
    for size in range(SHORTEST, LONGEST + 1):
        walking = cut(walking.withColumn("gram", F.substring(F.col("m"), F.col("place") + F.lit(1), F.lit(size))), "grams")
        written.append(walking)
        counts = walking.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
        met = walking.join(counts, "gram")
        goes_on = (F.col("freq") > frequent) & (F.col("place") + size < F.length("m")) if size < LONGEST else F.lit(False)
        ended = met.where(~goes_on).select("word", "n", "place", "gram", "freq")
        done = ended if done is None else done.unionByName(ended)
        walking = met.where(goes_on).select("word", "n", "m", "place")
    out = cut(done, "gram-places")
    drop(*written)
    return out


def _affected(places: Column, letters: Column) -> Column:
    """How many grams one edit can change: the most grams of `places` (sorted) over one letter of the marked word.

    A changed or lost letter changes the grams over it, a new one those over both of its neighbours.  Grams are at
    most LONGEST letters, so the grams over a letter start at most LONGEST places before it.
    """
    over = F.transform(
        F.sequence(F.lit(1), letters),
        lambda i: F.size(
            F.filter(
                F.slice(places, F.greatest(i - F.lit(LONGEST - 2), F.lit(1)), F.least(i + F.lit(1), F.lit(LONGEST))),
                lambda g: (g["place"] <= i) & (g["place"] + F.length(g["gram"]) > i),
            )
        ),
    )
    return F.array_max(over)


def postings(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """`word, n, place, gram, freq`: of each word, as many of its rarest grams as a variant is sure to share one of.

    A word with g grams of which an edit changes a at most shares g - a with any variant; in an order that is the
    same for all words, the first a + 1 grams of both hold the first that they share.
    """
    per_word = grams(words, frequent).groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("place", "gram", "freq"))).alias("g"))
    ordered = F.array_sort(F.transform("g", lambda g: F.struct(g["freq"].alias("freq"), g["gram"].alias("gram"), g["place"].alias("place"))))
    first = F.slice(ordered, F.lit(1), _affected(F.col("g"), F.length("word")) + F.lit(1))
    return per_word.select("word", "n", F.inline(first))


def _alike_in_half(words: DataFrame) -> DataFrame:
    """`a, an, word, n`: pairs of words of `word, n` that share the first or second half of the shorter one."""

    def halves(size: Column) -> Column:
        first = F.floor(size / 2).cast("int")
        return F.array(
            F.struct(F.lit("<").alias("side"), size.alias("length"), F.left("word", first).alias("half")),
            F.struct(F.lit(">").alias("side"), size.alias("length"), F.right("word", size - first).alias("half")),
        )

    length = F.length("word")
    own = words.select("word", "n", F.inline(halves(length)))
    asking = words.select(F.col("word").alias("a"), F.col("n").alias("an"), F.inline(F.concat(halves(length), halves(length - 1))))
    met = asking.join(own, ["side", "length", "half"]).where((F.length("a") > F.length("word")) | (F.col("a") < F.col("word")))
    return met.select("a", "an", "word", "n")


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def variants(words: DataFrame, frequent: int = FREQUENT, crowded: int = CROWDED) -> DataFrame:
    """`word, n, near, near_n`: both ways round, every two words that differ by one inserted, deleted or replaced
    letter.  `words` has `word, n`, of at least MIN_LETTERS letters each.

    Lists are by gram, length of the word and place.  The edit is on one side of a shared gram, and what is on the
    other side is equal; the list of a gram in more than `crowded` places is split by that, once for each side.
    """
    words = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.select(F.when(F.length("word") < MIN_LETTERS, F.raise_error(F.lit("a word is too short"))).otherwise(F.col("word")).alias("word"), "n")
    # A word of LONG + 1 letters may have a variant on either side.
    listed = cut(postings(words.where(F.length("word") <= LONG + 1), frequent), "postings")
    length, size = F.length("word"), F.length("gram")
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    head, tail = F.substring(marked, F.lit(1), F.col("place")), F.substring(marked, F.col("place") + size + F.lit(1), length + F.lit(2))
    # Nothing can be edited before the mark at the start or behind the one at the end.
    sides = F.filter(
        F.array(
            F.when(F.col("place") > 0, F.concat(F.lit(">"), tail)),
            F.when(F.col("place") + size < length + F.lit(2), F.concat(F.lit("<"), head)),
        ),
        lambda s: s.isNotNull(),
    )
    split = F.when(F.col("freq") > crowded, sides).otherwise(F.array(F.lit("")))
    keyed = listed.select("word", "n", "gram", "place", length.alias("length"), F.explode(split).alias("same"))
    # A word looks for others of its length at the same place, and for longer ones also one place on.
    looks = F.array(
        F.struct(F.lit(0).alias("longer"), F.lit(0).alias("on")),
        F.struct(F.lit(1).alias("longer"), F.lit(0).alias("on")),
        F.struct(F.lit(1).alias("longer"), F.lit(1).alias("on")),
    )
    asking = keyed.select(F.col("word").alias("a"), F.col("n").alias("an"), "gram", "same", "place", "length", F.inline(looks)).select(
        "a", "an", "gram", "same", (F.col("place") + F.col("on")).alias("place"), (F.col("length") + F.col("longer")).alias("length")
    )
    met = asking.join(keyed, ["gram", "same", "place", "length"]).where((F.length("a") < F.col("length")) | (F.col("a") < F.col("word")))
    met = met.select("a", "an", "word", "n").unionByName(_alike_in_half(words.where(F.length("word") > LONG)))
    pairs = cut(met.where(_one_edit(F.col("a"), F.col("word"))).select("a", "an", F.col("word").alias("b"), F.col("n").alias("bn")).distinct(), "variants")
    there = pairs.select(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n"))
    back = pairs.select(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n"))
    return there.unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """`word, root`: the last of the forms that follow from each word of `word, form`; no chain may be a circle.

    Each round doubles how far every word has followed.
    """
    state = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        after = cut(state.join(step, F.col("root") == F.col("_at"), "left").select("word", "root", "_next"), "roots")
        drop(state)
        moved = after.where("_next is not null").isEmpty()
        state = after.select("word", F.coalesce("_next", "root").alias("root"))
        if moved:
            return state
        state = cut(state, "roots")
        drop(after)


def spelling_groups(words: DataFrame, ratio: int = RATIO, frequent: int = FREQUENT) -> DataFrame:
    """`word, form, root, n, n_near, form_n` for all of `words` (`word, n`).

    `form` is the most frequent near word (the smallest of equals) if it is at least `ratio` times as frequent;
    `root` ends the chain of forms, and is the word itself where there is none.
    """
    words = cut(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = variants(words, frequent).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    )
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("best.form").alias("_form"), (-F.col("best.minus")).alias("_form_n")
    )
    counts = F.col("_form_n") >= F.lit(ratio) * F.col("n")
    found = cut(
        found.select("word", F.when(counts, F.col("_form")).alias("form"), "n", "n_near", F.when(counts, F.col("_form_n")).alias("form_n")), "forms"
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_words(docs: DataFrame, *, every: int = 199, min_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word, n`: the runs of all whole texts that occur `min_count` times; null texts have none.

    A run loses a letter where the CRC-32 of `<id>:<run>` (a null id is empty) is a multiple of `every`.
    """
    found = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs(F.coalesce(F.col(text_col), F.lit("")), MIN_LETTERS)).alias("run")
    )
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    lost = without_letter(F.col("run"), F.pmod(h, F.length("run")).cast("int"))
    word = F.when(F.pmod(h, F.lit(every)) == 0, lost).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).where(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)
