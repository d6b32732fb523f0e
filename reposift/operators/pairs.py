"""In-repository record pairs: generation, unpivoting, scoring, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift import defaults
from reposift.functions.text import clip_issue_text, combine_text, issue_key, normalize_text
from reposift.functions.vectors import dot
from reposift.operators.pair_lookup import look_up
from reposift.operators.similarity_join import similar_texts
from reposift.operators.validation import require_positive
from reposift.sources.issues import cap_per_repo
from reposift.sources.pairs import PAIR_KEY


def _meet(issues: DataFrame, keys: dict[str, Column], with_text: bool) -> DataFrame:
    """Pairs of issues with equal keys, the newer one first."""
    columns = [c.alias(name) for name, c in keys.items()] + [F.col("issue_number")]
    if with_text:
        columns.append(combine_text(F.col("title"), F.col("body")).alias("issue_text"))
    side = issues.select(*columns)

    def renamed(n: int) -> DataFrame:
        return side.withColumnsRenamed({"issue_number": f"issue_{n}_number", "issue_text": f"issue_{n}_text"})

    pairs = renamed(1).join(renamed(2), list(keys)).filter(F.col("issue_1_number") > F.col("issue_2_number"))
    texts = (["issue_1_text"], ["issue_2_text"]) if with_text else ([], [])
    return pairs.select("repo", "issue_1_number", *texts[0], "issue_2_number", *texts[1], F.lit("").alias("is_duplicate"))


def repo_pairs(issues: DataFrame, max_per_repo: int, with_text: bool = True) -> DataFrame:
    """Every unordered pair of a repository's ``max_per_repo`` newest issues: a corpus of bounded size, older issues left out."""
    return _meet(cap_per_repo(issues, max_per_repo), {"repo": F.col("repo_name")}, with_text)


def block_pairs(issues: DataFrame, width: int, with_text: bool = True) -> DataFrame:
    """Every unordered pair of a repository's issues whose numbers lie in one block of ``width`` numbers.

    No issue is left out, a block holds at most ``width`` of them, and the
    pairs of one repository are dealt to as many tasks as it has blocks.
    """
    require_positive(width=width)
    block = F.floor(F.col("issue_number") / width)
    return _meet(issues, {"repo": F.col("repo_name"), "block": block}, with_text)


def issue_texts(issues: DataFrame) -> DataFrame:
    """``repo, issue_number, issue_text``: title and body of each issue."""
    return issues.select(F.col("repo_name").alias("repo"), "issue_number", combine_text(F.col("title"), F.col("body")).alias("issue_text"))


def similar_pairs(issues: DataFrame, least: float = defaults.CLASSIFY_MIN_COSINE, with_text: bool = True) -> DataFrame:
    """Every pair of a repository's issues whose TF-IDF cosine is ``least`` or more, the newer one first, wherever their numbers lie.

    Pairs below ``least`` are never labelled by a classifier and aren't laid
    out.  The words of title and body count, as often as they occur.  With
    ``with_text`` the texts are attached to the pairs found.
    """
    texts = issue_texts(issues)
    found = similar_texts(texts, "repo", "issue_number", "issue_text", least)
    pairs = found.select("repo", F.col("number_1").alias("issue_1_number"), F.col("number_2").alias("issue_2_number"),
                         F.col("cosine").alias("cosine_similarity"), F.lit("").alias("is_duplicate"))
    if not with_text:
        return pairs
    pairs = look_up(pairs, texts.withColumnRenamed("issue_text", "value"), ("issue_1_text", "issue_2_text"), missing=False)
    return pairs.select("repo", "issue_1_number", "issue_1_text", "issue_2_number", "issue_2_text", "cosine_similarity", "is_duplicate")


def unpivot_pairs(pairs: DataFrame) -> DataFrame:
    """Both sides of every pair as rows, in one pass over the pairs."""
    sides = F.array(*[
        F.struct(F.lit(n).alias("side"), F.col(f"issue_{n}_number").alias("issue_number"),
                 F.col(f"issue_{n}_text").alias("issue_text"))
        for n in (1, 2)
    ])
    return pairs.select("repo", "issue_1_number", "issue_2_number", F.inline(sides))


def unique_issues(rows: DataFrame) -> DataFrame:
    """First row per issue: all first sides come before all second sides, newer pairs before older ones.

    ``min_by`` keeps one candidate per map task, so a key that occurs in very
    many pairs doesn't pile up anywhere.
    """
    position = F.struct("side", -F.col("issue_1_number"), -F.col("issue_2_number"))
    return rows.groupBy("repo", "issue_number").agg(F.min_by("issue_text", position).alias("issue_text"))


def issue_table(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The distinct issues behind the pairs, with normalised text and key; each is embedded once.

    With ``texts(repo, issue_number, issue_text)`` the pairs need no texts:
    each is looked up once for its issue, not carried by every pair.
    """
    if texts is None:
        first = unique_issues(unpivot_pairs(pairs))
    else:
        numbers = pairs.withColumns({f"issue_{n}_text": F.lit(None).cast("string") for n in (1, 2)})
        own = texts.groupBy("repo", "issue_number").agg(F.min("issue_text").alias("issue_text"))
        first = unique_issues(unpivot_pairs(numbers)).drop("issue_text").join(own, ["repo", "issue_number"])
    return first.select(
        "repo", "issue_number", normalize_text(F.col("issue_text")).alias("issue_text"),
        issue_key(F.col("repo"), F.col("issue_number")).alias("issue_key"),
    )


def pair_embeddings(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Both vectors next to each pair; a vector that isn't there stays null.

    ``vectors(repo, issue_number, embedding)``, looked up block by block, so that
    no pair is shuffled with a vector beside it.
    """
    values = vectors.select("repo", "issue_number", F.col("embedding").alias("value"))
    return look_up(pairs, values, ("embedding_1", "embedding_2"), missing=True)


def missing_vectors(with_vectors: DataFrame) -> DataFrame:
    """Keys without a vector, once each."""
    gaps = F.array(*[
        F.struct(F.col("repo"), F.col(f"issue_{n}_number").alias("issue_number"), F.col(f"embedding_{n}").isNull().alias("gone"))
        for n in (1, 2)
    ])
    return with_vectors.select(F.inline(gaps)).filter("gone").select("repo", "issue_number").distinct()


def score_pairs(pairs: DataFrame, vectors: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``cosine_similarity``, the dot product of two unit vectors, not clamped.

    ``strict`` fails the job when a vector is missing; otherwise such pairs are
    left out here and reported by :func:`missing_vectors`.
    """
    met = pairs
    for n in (1, 2):
        side = vectors.select(
            "repo", F.col("issue_number").alias(f"issue_{n}_number"), F.col("embedding").alias(f"embedding_{n}"))
        met = met.join(side, ["repo", f"issue_{n}_number"], "left")
    complete = F.col("embedding_1").isNotNull() & F.col("embedding_2").isNotNull()
    score = dot(F.col("embedding_1"), F.col("embedding_2"))
    if strict:
        message = F.concat(F.lit("no vector for a pair of "), F.col("repo"))
        score = F.when(complete, score).otherwise(F.raise_error(message).cast("double"))
    else:
        met = met.filter(complete)
    return met.withColumn("cosine_similarity", score).drop("embedding_1", "embedding_2")


def is_labelled(label: Column) -> Column:
    return F.coalesce(F.trim(label.cast("string")) != "", F.lit(False))


def latest_labels(progress: DataFrame, order_by: str | None = None) -> DataFrame:
    """One usable label per pair; the last one by ``order_by`` wins."""
    order = F.struct(*([order_by] if order_by else []), "final_confidence", "is_duplicate")
    usable = progress.filter(is_labelled(F.col("is_duplicate")))
    return usable.groupBy(*PAIR_KEY).agg(F.max_by(F.struct("is_duplicate", "final_confidence"), order).alias("last")).select(
        *PAIR_KEY, F.col("last.is_duplicate").alias("is_duplicate"), F.col("last.final_confidence").alias("final_confidence"))


def merge_progress(table: DataFrame, progress: DataFrame, order_by: str | None = None) -> DataFrame:
    """Earlier labels win over the ones in the table; every row of the table stays."""
    previous = latest_labels(progress, order_by).select(
        *PAIR_KEY, F.col("is_duplicate").alias("_label"), F.col("final_confidence").alias("_confidence"))
    out = table.join(previous, PAIR_KEY, "left")
    for name, earlier in (("is_duplicate", "_label"), ("final_confidence", "_confidence")):
        current = F.col(name).cast(previous.schema[earlier].dataType) if name in table.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(F.col(earlier), current))
    return out.drop("_label", "_confidence")


def unlabelled(table: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Pairs still to classify: without a label of their own and not among ``labels``."""
    open_pairs = table.filter(~is_labelled(F.col("is_duplicate"))) if "is_duplicate" in table.columns else table
    if labels is None:
        return open_pairs
    done = labels.filter(is_labelled(F.col("is_duplicate"))).select(*PAIR_KEY)
    return open_pairs.join(done, PAIR_KEY, "left_anti")


def coerce_pair_types(table: DataFrame, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed pairs with normalised texts, clipped to ``max_chars`` if given, and the rows whose key or score can't be read."""
    wanted = {"repo": "string", "issue_1_number": "bigint", "issue_2_number": "bigint", "cosine_similarity": "double"}
    bad = F.lit(False)
    for name, kind in wanted.items():
        bad = bad | F.col(name).try_cast(kind).isNull()
    judged = table.withColumn("_bad", bad)
    clean = (lambda c: clip_issue_text(c, max_chars)) if max_chars else normalize_text
    typed = judged.filter(~F.col("_bad")).withColumns({
        **{name: F.col(name).try_cast(kind) for name, kind in wanted.items()},
        **{f"issue_{n}_text": clean(F.col(f"issue_{n}_text")) for n in (1, 2)},
    })
    return typed.drop("_bad"), judged.filter("_bad").drop("_bad")


def similar_counts(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """Issues and given pairs per repository; repositories without a pair have 0."""
    found = pairs.groupBy(F.col("repo").alias("repo_name")).agg(F.count(F.lit(1)).alias("pairs"))
    return issues.groupBy("repo_name").agg(F.count(F.lit(1)).alias("issues")).join(found, "repo_name", "left").fillna(0, ["pairs"])


def whole_counts(issues: DataFrame) -> DataFrame:
    """Issues and all pairs per repository, alike or not, without making the pairs; rows of one number are one issue of a pair."""
    n = F.count_distinct("issue_number")
    made = F.when(F.col("repo_name").isNotNull(), n * (n - 1) / 2).otherwise(0).cast("bigint")
    return issues.groupBy("repo_name").agg(F.count(F.lit(1)).alias("issues"), made.alias("pairs"))


def pair_counts(issues: DataFrame, width: int) -> DataFrame:
    """Issues and pairs of :func:`block_pairs` per repository, without making the pairs."""
    blocks = issues.groupBy("repo_name", F.floor(F.col("issue_number") / width).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    made = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    return blocks.groupBy("repo_name").agg(F.sum("n").alias("issues"), F.sum(made).alias("pairs"))
