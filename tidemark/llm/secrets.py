"""Secrets in texts, and whose they are: candidates are hashed and counted over distinct repositories and owners.

A value that many owners have is an example that was copied around; one that a single owner has and that looks
random is a live credential.  Everything is DataFrame functions: patterns find candidates, splitting by the same
pattern gives their places, and only hashes of values are shuffled or written, never a value.

Null texts are empty; a null repository is the repository ''; rows without an id or that repeat one are judged row
by row; an empty table gives no rows; no other column is read.  A text of any length is searched whole, and its
candidates are the largest group that one task sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

# The kinds in their order, what matches and the least length of the value (of the match, but for assign).
KINDS = ("assign", "access", "hex", "bare")
PATTERNS = {
    "assign": "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    # Not part of the base: any longer run that may be a credential by itself.
    "bare": "[A-Za-z0-9_-]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24, "bare": 20}

MAX_OWNERS = 2
MAX_REPOS = 4
# What a random value has: length, digits, different characters, and no long run of letters as words have.
LIVE_LENGTH = 16
LIVE_DIGITS = "([0-9][^0-9]*){4}"
LIVE_CHARACTERS = 8
WORDLIKE = "[a-z]{8}|[A-Z]{8}"


def owner_of(repo: Column) -> Column:
    """The part of a repository's name before its first slash."""
    return F.substring_index(repo, "/", 1)


def _live(value: Column) -> Column:
    return (
        (F.length(value) >= LIVE_LENGTH) & value.rlike(LIVE_DIGITS) & ~value.rlike(WORDLIKE)
        & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)
    )


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind in order, each with the length of the text between it and the one before."""
    pattern = PATTERNS[kind]
    if kind != "assign":
        # A run is as long as it can be, so asking for its least length in the pattern finds the same ones sooner.
        start = "AKIA" if kind == "access" else ""
        pattern = f"{pattern[:-1]}{{{LEAST[kind] - len(start)},}}"
    wanted = F.lit(pattern)
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, wanted, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, wanted, F.lit(2 if kind == "assign" else 0)).alias("value"),
        # One piece more than there are matches; the last has no match and goes.
        F.split(text, pattern, -1).alias("gap"),
    )
    rows = F.transform(
        F.filter(pieces, lambda m: m["whole"].isNotNull()),
        lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("i"),
            F.length(m["gap"]).cast("bigint").alias("gap"),
            F.length(m["whole"]).cast("bigint").alias("size"),
            (F.length(m["value"]) >= LEAST[kind]).alias("kept"),
            F.sha2(m["value"], 256).alias("hash"),
            _live(m["value"]).alias("live"),
        ),
    )
    return F.when(text.rlike(pattern), rows)


def _searched(docs: DataFrame, id_col: str, text_col: str, repo_col: str) -> DataFrame:
    """`row, doc_id, repo, found`: one row per row of `docs`, with its candidates of all kinds.  Written once."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo")
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:bigint,size:bigint,kept:boolean,hash:string,live:boolean>>")
    found = F.concat(*[F.coalesce(_matches(F.col("text"), kind), none) for kind in KINDS])
    # The number of a row is only used after it is written, so it need not be the same on every run.
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", found.alias("found")), "secrets")


def ownership(candidates: DataFrame) -> DataFrame:
    """`hash, n_repos, n_owners`: in how many different repositories and owners each candidate of `hash, repo` is.

    Rows are brought to one per hash and repository first, map-side, so a hash that is everywhere costs one row
    for each repository.
    """
    places = candidates.groupBy("hash", "repo").agg(F.count(F.lit(1)).alias("_n"))
    owners = places.groupBy("hash", owner_of(F.col("repo")).alias("owner")).agg(F.count(F.lit(1)).alias("_repos"))
    return owners.groupBy("hash").agg(F.sum("_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def _judged(searched: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """`row, doc_id, kind, start, end, hash, n_repos, n_owners, verdict`: base spans, and bare ones that are live."""
    each = searched.select("row", "doc_id", "repo", F.inline("found"))
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    kept = placed.where("kept")
    # Bare runs that touch a base span say nothing new.
    base = F.col("kind") < F.lit(KINDS.index("bare"))
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    free = (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.col("end")) >= F.col("end")
    )
    spans = cut(
        kept.withColumn("free", free).where(base | (F.col("free") & F.col("live"))).select("row", "doc_id", "repo", "kind", "start", "end", "hash", "live"),
        "secret-spans",
    )
    verdict = (
        F.when((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos), "copied").when(F.col("live"), "live").otherwise("plain")
    )
    met = spans.join(ownership(spans), "hash").withColumn("verdict", verdict).where(base | (F.col("verdict") == "live"))
    return met.select("row", "doc_id", "kind", "start", "end", "hash", "n_repos", "n_owners", "verdict")


def secret_spans(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row per span of a secret: `doc_id, kind, start, end` (code points, end exclusive), `hash` (SHA-256 of the
    value), `n_repos, n_owners` that have the value anywhere, and `verdict`.

    The verdict is `copied` beyond `max_owners` owners or `max_repos` repositories, else `live` where the value looks
    random, else `plain`.  Spans of kind `bare` are runs by themselves; only live ones are returned.
    """
    spans = _judged(_searched(docs, id_col, text_col, repo_col), max_owners, max_repos)
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + F.lit(1))
    return spans.drop("row").withColumn("kind", names)


def secrets_by_document(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row per row of `docs`: `doc_id` and `secrets`, its spans as an array of `kind, start, end, hash, n_repos,
    n_owners, verdict` by start, then kind; empty where there are none."""
    searched = _searched(docs, id_col, text_col, repo_col)
    spans = _judged(searched, max_owners, max_repos)
    per_row = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "n_repos", "n_owners", "verdict"))).alias("secrets")
    )
    none = F.array().cast(per_row.schema["secrets"].dataType)
    return searched.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", F.coalesce("secrets", none).alias("secrets"))


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """`doc_id`, counts by kind and verdict, `base_sha256` of the base spans and `spans`, as `kind:start:end` by commas."""
    found = secrets_by_document(docs, **options)
    names = F.array(*[F.lit(k) for k in KINDS])
    secrets, bare = F.col("secrets"), KINDS.index("bare")

    def joined(spans: Column) -> Column:
        texts = F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + F.lit(1)), s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(texts, ",")

    def count(test) -> Column:
        return F.size(F.filter(secrets, test)).cast("bigint")

    def of_kind(kind: int) -> Column:
        return count(lambda s: s["kind"] == kind)

    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "copied").alias("n_copied"),
        F.sha2(joined(F.filter(secrets, lambda s: s["kind"] < bare)), 256).alias("base_sha256"),
        joined(secrets).alias("spans"),
    )
