"""Cosine neighbours of vectors, restricted to one repository.

The join never lays out all pairs of a repository as rows.  Vectors are split
into blocks of bounded size, block pairs are multiplied inside Arrow batches
and only the best ``k`` matches per query and block leave a task:

* every vector belongs to the cluster of its nearest pivot; pivots are picked by
  hash order, as many as the caller states or else the square root of the
  number of blocks, so what is collected and sent to tasks grows far slower
  than the data;
* a cluster of a large repository is salted into sub-blocks of about
  ``block_rows`` rows, which keeps a repository holding a third of all rows
  from landing in one task;
* the exact search first looks into one block near the query and then visits
  only clusters which, by the triangle inequality on angles, may still hold a
  match as good as the k-th best so far (pivot-partitioned kNN join, Lu et al.,
  PVLDB 2012); blocks travel in bundles, so a vector is sent once to each
  bundle of its repository that it must meet and not to each block;
* the approximate search visits the ``n_probe`` clusters of the repository that
  are nearest to the query (inverted-file probing, Jegou et al., TPAMI 2011),
  and more where those hold too few vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reposift import defaults
from reposift.functions.vectors import distance_to_similarity
from reposift.operators.validation import require_positive
from reposift.session import cut_lineage

BLOCK_ROWS = 4096
#: Rows of a bundle of blocks at most, and in how many bundles a smaller repository comes, if they have a block each, so that several tasks share it.
BUNDLE_ROWS, SPREAD = 32768, 8
#: Similarities that a task forms at once.
TILE = 1 << 22
SIMILARITY_DECIMALS = 9

_MATCH_SCHEMA = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("query_number", T.LongType()),
    T.StructField("match_number", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("similarity", T.DoubleType()),
])
_PAIR_KEY = ["repo_name", "q_cluster", "q_sub", "v_cluster", "v_sub"]


def _block_kernel(k: int, exclude_self: bool, earlier_only: bool):
    """Top-k of one query block against one candidate block.

    Queries with a ``floor`` keep nothing below it and skip the candidates of
    their home block, ``home_sub`` of this cluster, which they have met.
    """
    columns = [f.name for f in _MATCH_SCHEMA.fields]
    decimals, tile = SIMILARITY_DECIMALS, TILE
    # pandas' own string type can come out as no or several Arrow chunks, which Arrow batches can't take
    text_columns = {"repo_name": object, "title": object}

    def unit_rows(series):
        import numpy as np

        rows = np.stack(series.to_numpy()).astype("float64")
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(lengths > 0, lengths, 1.0)

    def best_matches(left, right):
        import numpy as np
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in columns}).astype(text_columns)
        right = right.sort_values("match_number", kind="stable")
        numbers = right["match_number"].to_numpy()
        titles = right["title"].to_numpy(dtype=object)
        candidates = unit_rows(right["match_vector"])
        queries = unit_rows(left["embedding"])
        asked = left["query_number"].to_numpy()
        repo = left["repo_name"].iloc[0]
        parts, step = [], max(16, min(512, tile // len(candidates)))
        seen = "floor" in left
        if seen:
            met = np.where(left["cluster"] == right["m_cluster"].iloc[0], left["home_sub"].fillna(-1), -1).astype("int64")
            subs, least = right["m_sub"].to_numpy(), left["floor"].to_numpy()
        for start in range(0, len(asked), step):
            mine = asked[start:start + step]
            sims = np.round(queries[start:start + step] @ candidates.T, decimals)
            if seen:
                sims[(met[start:start + step, None] == subs[None, :]) | (sims < least[start:start + step, None])] = -np.inf
            if exclude_self:
                sims[mine[:, None] == numbers[None, :]] = -np.inf
            if earlier_only:
                sims[mine[:, None] <= numbers[None, :]] = -np.inf
            keep = min(k, sims.shape[1])
            floor = np.partition(sims, sims.shape[1] - keep, axis=1)[:, -keep]
            # ties with the k-th best are all kept here and cut in number order below
            rows, cols = np.nonzero((sims >= floor[:, None]) & np.isfinite(sims))
            values = sims[rows, cols]
            order = np.lexsort((cols, -values, rows))
            rows, cols, values = rows[order], cols[order], values[order]
            first = np.searchsorted(rows, rows, side="left")
            top = (np.arange(len(rows)) - first) < keep
            rows, cols, values = rows[top], cols[top], values[top]
            parts.append((mine[rows], numbers[cols], titles[cols], values))
        asked, matched, names, values = (np.concatenate(column) for column in zip(*parts))
        return pd.DataFrame({
            "repo_name": repo, "query_number": asked, "match_number": matched, "title": names, "similarity": values,
        })[columns].astype(text_columns)

    return best_matches


def _bundle_kernel(k: int, exclude_self: bool, earlier_only: bool):
    """Top-k of a bundle of queries against the clusters of a bundle of candidates that each query wants."""
    best_matches = _block_kernel(k, exclude_self, earlier_only)

    def best_of_bundle(left, right):
        import pandas as pd

        parts = [best_matches(left, right[:0])]
        for cluster, block in right.groupby("m_cluster"):
            parts.append(best_matches(left[[cluster in wanted for wanted in left["wanted"]]], block))
        found = pd.concat([p for p in parts if len(p)] or parts)
        found = found.sort_values(["query_number", "similarity", "match_number"], ascending=[True, False, True], kind="stable")
        return found.groupby("query_number", dropna=False).head(k)

    return best_of_bundle


def _rank(matches: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("repo_name", "query_number").orderBy(F.desc("similarity"), F.asc("match_number"))
    return (
        matches.withColumn("rnk", F.row_number().over(order))
        .filter(F.col("rnk") <= k)
        .select(
            "repo_name", "query_number", "match_number", "title",
            (F.lit(1.0) - F.col("similarity")).alias("distance"),
            distance_to_similarity(F.lit(1.0) - F.col("similarity")).alias("similarity_score"),
            F.col("rnk").cast("bigint").alias("rnk"),
        )
    )


def _no_matches(vectors: DataFrame) -> DataFrame:
    """What any number of queries find in an empty table."""
    return vectors.sparkSession.createDataFrame([], _MATCH_SCHEMA)


def _pick_pivots(vectors: DataFrame, n_clusters: int) -> list[list[float]]:
    """``n_clusters`` vectors in hash order: a repeatable choice."""
    spread = F.xxhash64("repo_name", "issue_number")
    rows = vectors.select("embedding").orderBy(spread, "repo_name", "issue_number").limit(n_clusters).collect()
    return [[float(x) for x in row.embedding] for row in rows]


def _nearest_pivots(pivots: list[list[float]], how_many: int):
    """Arrow function: the nearest pivots of a vector and the angle to each."""

    @F.pandas_udf("array<struct<cluster:int,angle:double>>")
    def nearest(embedding):
        import numpy as np
        import pandas as pd

        if len(embedding) == 0:
            return pd.Series([], dtype=object)
        centres = np.asarray(pivots)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        rows = np.stack(embedding.to_numpy()).astype("float64")
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        sims = np.clip((rows / np.where(lengths > 0, lengths, 1.0)) @ centres.T, -1.0, 1.0)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :how_many]
        angles = np.arccos(np.take_along_axis(sims, order, axis=1))
        return pd.Series([
            [{"cluster": int(c), "angle": float(a)} for c, a in zip(cs, angs)] for cs, angs in zip(order, angles)
        ])

    return nearest.asNondeterministic()  # one evaluation, whatever is filtered later


def _reachable_clusters(pivots: list[list[float]]):
    """Arrow function: clusters that may hold a match at least as similar as ``floor``."""

    @F.pandas_udf("array<int>")
    def reachable(embedding, floor, clusters, radii):
        import numpy as np
        import pandas as pd

        if len(embedding) == 0:
            return pd.Series([], dtype=object)
        centres = np.asarray(pivots)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        rows = np.stack(embedding.to_numpy()).astype("float64")
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        angles = np.arccos(np.clip((rows / np.where(lengths > 0, lengths, 1.0)) @ centres.T, -1.0, 1.0))
        out = []
        for mine, least, ids, radius in zip(angles, floor, clusters, radii):
            nearest_possible = np.maximum(mine[ids] - radius, 0.0)
            # the slack covers rounding of similarities and of arccos near 0
            out.append(np.asarray(ids)[np.cos(nearest_possible) >= least - 1e-6].tolist())
        return pd.Series(out)

    return reachable.asNondeterministic()


def _probed_clusters(pivots: list[list[float]], n_probe: int, least_rows: int):
    """Arrow function: the nearest of the given clusters, ``n_probe`` of them or as many as hold ``least_rows`` rows."""

    @F.pandas_udf("array<int>")
    def probed(embedding, clusters, sizes):
        import numpy as np
        import pandas as pd

        if len(embedding) == 0:
            return pd.Series([], dtype=object)
        centres = np.asarray(pivots)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        rows = np.stack(embedding.to_numpy()).astype("float64")
        out = []
        for row, ids, held in zip(rows, clusters, sizes):
            order = np.argsort(-(centres[ids] @ row), kind="stable")
            enough = int(np.searchsorted(np.cumsum(np.asarray(held)[order]), least_rows)) + 1
            out.append(np.asarray(ids)[order[: max(n_probe, enough)]].tolist())
        return pd.Series(out)

    return probed.asNondeterministic()


def _sub_block(number: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(number), F.coalesce(parts, F.lit(1))).cast("int")


def _cluster_stats(rows: DataFrame, block_rows: int) -> DataFrame:
    return rows.groupBy("repo_name", "cluster").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"), F.max("angle").alias("radius"),
        F.count(F.lit(1)).alias("held"),
    )


def _with_sub_block(rows: DataFrame, stats: DataFrame, number: str) -> DataFrame:
    """Salt the rows of large clusters; only clusters of more than one block are joined."""
    large = stats.filter("parts > 1").select("repo_name", "cluster", "parts")
    return (
        rows.join(large, ["repo_name", "cluster"], "left")
        .withColumn("sub", _sub_block(F.col(number), F.col("parts")))
        .drop("parts")
    )


def _multiply(query_pairs: DataFrame, blocks: DataFrame, kernel) -> DataFrame:
    """Run the kernel on block pairs.

    ``query_pairs`` holds query rows with the block pair they take part in.  A
    candidate block is copied once per distinct pair, never once per query.
    """
    wanted = query_pairs.select(*_PAIR_KEY).distinct()
    candidates = blocks.select(
        "repo_name", F.col("cluster").alias("v_cluster"), F.col("sub").alias("v_sub"),
        F.col("issue_number").alias("match_number"), "title", "embedding",
    ).join(wanted, ["repo_name", "v_cluster", "v_sub"])
    left = query_pairs.select(*_PAIR_KEY, "query_number", "embedding").groupBy(*_PAIR_KEY)
    right = _candidate_columns(candidates, _PAIR_KEY).groupBy(*[f"m_{c}" for c in _PAIR_KEY])
    return left.cogroup(right).applyInPandas(kernel, _MATCH_SCHEMA)


def _bundles(stats: DataFrame, block_rows: int) -> DataFrame:
    """Clusters with their ``bundle``, which small ones share, and the ``pieces`` that a large one is cut into."""
    whole = F.sum("held").over(Window.partitionBy("repo_name"))
    rows = F.least(F.lit(BUNDLE_ROWS), F.greatest(F.lit(block_rows), F.ceil(whole / SPREAD)))
    shared = F.lit(-1) - F.pmod(F.xxhash64("cluster"), F.ceil(whole / rows))
    return stats.withColumn("pieces", F.ceil(F.col("held") / rows).cast("int")).withColumn(
        "bundle", F.when(F.col("pieces") > 1, F.col("cluster")).otherwise(shared).cast("int"))


def _multiply_bundles(visits: DataFrame, homes: DataFrame, blocks: DataFrame, stats: DataFrame, block_rows: int, kernel) -> DataFrame:
    """Run the kernel on pairs of bundles; ``visits`` holds queries with the candidate bundles and clusters that they want."""
    own = _bundles(_cluster_stats(homes, block_rows), block_rows).select(
        "repo_name", "cluster", F.col("bundle").alias("q_bundle"), F.col("pieces").alias("q_pieces"))
    key = ["repo_name", "q_bundle", "q_piece", "v_bundle", "v_piece"]
    left = visits.join(own, ["repo_name", "cluster"]).withColumn("q_piece", F.pmod("sub", "q_pieces").cast("int")).select(
        *key, "query_number", "embedding", "floor", "cluster", "home_sub", "wanted")
    wanted = left.select(*key, F.explode("wanted").alias("cluster")).distinct()
    placed = blocks.join(stats.select("repo_name", "cluster", "pieces"), ["repo_name", "cluster"]).select(
        "repo_name", "cluster", F.pmod("sub", "pieces").cast("int").alias("v_piece"), "sub", F.col("issue_number").alias("match_number"), "title", "embedding")
    candidates = placed.join(wanted, ["repo_name", "cluster", "v_piece"])
    right = _candidate_columns(candidates, [*key, "cluster", "sub"]).groupBy(*[f"m_{c}" for c in key])
    return left.groupBy(*key).cogroup(right).applyInPandas(kernel, _MATCH_SCHEMA)


def _candidate_columns(candidates: DataFrame, key: list[str]) -> DataFrame:
    """New names all through, so a table can be searched with its own rows as queries."""
    return candidates.select(
        *[F.col(c).alias(f"m_{c}") for c in key], F.col("match_number").alias("match_number"),
        F.col("title").alias("title"), F.col("embedding").alias("match_vector"),
    )


def _prepare(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = queries.select("repo_name", F.col("issue_number").cast("bigint").alias("query_number"), "embedding")
    title = F.col("title") if "title" in vectors.columns else F.lit(None).cast("string").alias("title")
    known = vectors.select("repo_name", F.col("issue_number").cast("bigint").alias("issue_number"), title, "embedding")
    return asked, known


def _choose_clusters(vectors: DataFrame, queries: DataFrame, n_clusters: int | None, block_rows: int) -> int:
    if n_clusters is None:
        size = max(vectors.count(), 0 if queries is vectors else queries.count())
        n_clusters = math.ceil(math.sqrt(size / block_rows))
    return max(1, n_clusters)


def knn_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = defaults.KNN_LIMIT,
    *,
    exclude_self: bool = False,
    earlier_only: bool = False,
    n_clusters: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact ``k`` most similar records of the same repository for every query.

    ``queries(repo_name, issue_number, embedding)`` and
    ``vectors(repo_name, issue_number, title, embedding)`` give
    ``(repo_name, query_number, match_number, title, distance, similarity_score, rnk)``.
    Ranking is by distance, then by number; the score is clamped to [0, 1]
    after ranking.  A query is not removed from its own matches unless
    ``exclude_self`` is set; ``earlier_only`` admits lower numbers only.
    """
    require_positive(k=k, block_rows=block_rows)
    clusters = _choose_clusters(vectors, queries, n_clusters, block_rows)
    kernel = _block_kernel(k, exclude_self, earlier_only)
    asked, known = _prepare(queries, vectors)

    if clusters == 1:
        # everything fits one block: a repository is one group of at most block_rows rows
        one_block = {"q_cluster": F.lit(0), "q_sub": F.lit(0), "v_cluster": F.lit(0), "v_sub": F.lit(0)}
        if n_clusters is None:
            left = asked.groupBy("repo_name")
            candidates = known.withColumnRenamed("issue_number", "match_number")
            right = _candidate_columns(candidates, ["repo_name"]).groupBy("m_repo_name")
            return _rank(left.cogroup(right).applyInPandas(kernel, _MATCH_SCHEMA), k)
        blocks = known.withColumn("cluster", F.lit(0)).withColumn("angle", F.lit(math.pi))
        stats = _cluster_stats(blocks, block_rows)
        blocks = _with_sub_block(blocks, stats, "issue_number")
        homes = asked.withColumn("cluster", F.lit(0)).withColumn("angle", F.lit(math.pi))
        homes = _with_sub_block(homes, _cluster_stats(homes, block_rows), "query_number")
        pairs = homes.join(stats.select("repo_name", "parts"), "repo_name").withColumns({
            **one_block, "q_sub": F.col("sub"), "v_sub": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
        })
        return _rank(_multiply(pairs, blocks, kernel), k)

    pivots = _pick_pivots(known, clusters)
    if not pivots:
        return _rank(_no_matches(known), k)
    blocks, homes, stats = _assign(None if queries is vectors else asked, known, pivots, block_rows)

    # 1. one block near the query gives a lower bound for its k-th best match
    home_pairs = (
        homes.join(stats.select("repo_name", "cluster", "parts"), ["repo_name", "cluster"])
        .withColumns({
            "q_cluster": F.col("cluster"), "q_sub": F.col("sub"), "v_cluster": F.col("cluster"),
            "v_sub": F.pmod(F.col("sub"), F.col("parts")).cast("int"),
        })
    )
    near = cut_lineage(_multiply(home_pairs, blocks, kernel))

    # 2. every other block that the bound cannot rule out
    bound = near.groupBy("repo_name", "query_number").agg(
        F.count(F.lit(1)).alias("found"), F.min("similarity").alias("least")
    )
    floor = F.when(F.col("found") >= k, F.col("least")).otherwise(F.lit(-2.0))
    # at most one entry per pivot and repository
    bundles = _bundles(stats, block_rows)
    entry = F.struct("cluster", "radius", "parts", "pieces", "bundle")
    reach = bundles.groupBy("repo_name").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    visits = (
        homes.join(bound, ["repo_name", "query_number"], "left")
        .join(reach, "repo_name")
        .withColumn("floor", floor)
        .withColumn("within", _reachable_clusters(pivots)("embedding", F.col("floor"), F.col("c.cluster"), F.col("c.radius")))
        .withColumn("home_sub", F.pmod(F.col("sub"), F.filter("c", lambda x: x.cluster == F.col("cluster"))[0]["parts"]).cast("int"))
        # a cluster of one block has been met at home
        .withColumn("hits", F.filter("c", lambda x: F.array_contains("within", x.cluster) & ~((x.cluster == F.col("cluster")) & (x.parts == 1))))
        .withColumn("v_bundle", F.explode(F.array_distinct(F.transform("hits", lambda x: x.bundle))))
        .withColumn("hits", F.filter("hits", lambda x: x.bundle == F.col("v_bundle")))
        .withColumn("wanted", F.transform("hits", lambda x: x.cluster))
        .withColumn("v_piece", F.explode(F.sequence(F.lit(0), F.col("hits")[0]["pieces"] - 1)))
    )
    far = _multiply_bundles(visits, homes, blocks, bundles, block_rows, _bundle_kernel(k, exclude_self, earlier_only))
    return _rank(near.unionByName(far), k)


def _assign(asked: DataFrame | None, known: DataFrame, pivots, block_rows: int):
    """Cluster and sub-block of every vector and query, plus sizes and radii of the clusters.

    The placed rows are written down: every later step reads them.  Without
    ``asked`` the vectors are their own queries and are placed once.
    """

    def place(rows: DataFrame) -> DataFrame:
        home = _nearest_pivots(pivots, 1)("embedding")[0]
        placed = rows.withColumn("home", home)
        return cut_lineage(placed.withColumns({"cluster": F.col("home.cluster"), "angle": F.col("home.angle")}).drop("home"))

    placed = place(known)
    stats = _cluster_stats(placed, block_rows)
    blocks = _with_sub_block(placed, stats, "issue_number")
    if asked is None:
        return blocks, blocks.withColumnRenamed("issue_number", "query_number").drop("title"), stats
    homes = place(asked)
    return blocks, _with_sub_block(homes, _cluster_stats(homes, block_rows), "query_number"), stats


def probe_join(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = defaults.KNN_LIMIT,
    *,
    n_clusters: int,
    n_probe: int,
    exclude_self: bool = False,
    min_similarity: float | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate :func:`knn_topk` by probing clusters: only the repository's ``n_probe`` clusters nearest to the query are searched.

    The caller states clusters and probes; the plan is the same at every size.
    The matches are a part of all pairs and their scores are exact; raising
    ``n_probe`` to ``n_clusters`` gives the exact result.  A query gets ``k``
    matches wherever its repository holds as many: clusters are added until
    they hold enough rows.
    """
    require_positive(k=k, n_clusters=n_clusters, n_probe=n_probe, block_rows=block_rows)
    asked, known = _prepare(queries, vectors)
    pivots = _pick_pivots(known, n_clusters)
    if not pivots:
        return _rank(_no_matches(known), k)
    blocks, homes, stats = _assign(None if queries is vectors else asked, known, pivots, block_rows)
    own = stats.groupBy("repo_name").agg(F.sort_array(F.collect_list(F.struct("cluster", "held"))).alias("own"))
    probed = _probed_clusters(pivots, n_probe, k + int(exclude_self))
    visits = (
        homes.join(own, "repo_name")
        .withColumn("v_cluster", F.explode(probed("embedding", F.col("own.cluster"), F.col("own.held"))))
        .join(stats.select("repo_name", F.col("cluster").alias("v_cluster"), "parts"), ["repo_name", "v_cluster"])
        .withColumn("v_sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"q_cluster": F.col("cluster"), "q_sub": F.col("sub")})
    )
    found = _rank(_multiply(visits, blocks, _block_kernel(k, exclude_self, False)), k)
    return found if min_similarity is None else found.filter(F.col("similarity_score") >= min_similarity)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact matches the approximate join found."""
    key = ["repo_name", "query_number", "match_number"]
    hits = exact.select(*key).join(approximate.select(*key).withColumn("hit", F.lit(1)), key, "left")
    return hits.agg(
        F.count("hit").alias("found"), F.count(F.lit(1)).alias("expected"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"),
    )


def duplicate_decision(
    queries: DataFrame,
    vectors: DataFrame,
    threshold: float = defaults.SIMILARITY_THRESHOLD,
    *,
    exclude_self: bool = True,
    earlier_only: bool = False,
    **search,
) -> DataFrame:
    """Best match per query and the verdict; a query without match gets score 0.

    Gives ``(repo_name, issue_number, is_duplicate, similarity_score, duplicate_of_number)``.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be in [0, 1]")
    best = knn_topk(queries, vectors, 1, exclude_self=exclude_self, earlier_only=earlier_only, **search)
    best = best.select("repo_name", F.col("query_number").alias("issue_number"), "match_number", "similarity_score")
    return decide(queries.select("repo_name", "issue_number").join(best, ["repo_name", "issue_number"], "left"), threshold)


def reaches_threshold(score: Column, threshold: float = defaults.SIMILARITY_THRESHOLD) -> Column:
    """A score equal to the threshold counts as reached."""
    return score >= F.lit(float(threshold))


def decide(best: DataFrame, threshold: float) -> DataFrame:
    score = F.coalesce(F.col("similarity_score"), F.lit(0.0))
    duplicate = reaches_threshold(score, threshold) & F.col("match_number").isNotNull()
    return best.select(
        "repo_name", "issue_number", duplicate.alias("is_duplicate"), score.alias("similarity_score"),
        F.when(duplicate, F.col("match_number")).alias("duplicate_of_number"),
    )
