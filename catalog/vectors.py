"""Embedding, neighbour search, verdicts, the vector table, and row validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import view, with_views
from catalog.text import clean_sql, trim_sql
from reposift.operators import lsh
from reposift.operators import neighbours as N
from reposift.operators import validation as V
from reposift.operators.embedding import embed_issues
from reposift.functions.text import combine_text
from reposift.functions.text import match_message as message_text
from reposift.functions.text import pr_payload
from reposift.operators.tfidf import embed_tfidf as fitted_vectors
from reposift.plans import duplicates as D
from reposift.session import work_path
from reposift.sinks import vector_table as T
from reposift.sinks.actions import triage_actions as actions
from reposift.sources.commits import pr_commit_messages as joined_messages

THRESHOLD = 0.35  # the given vectors are nearly orthogonal; the default would select none


def _vectors(spark, folder):
    return view(spark, folder, "vectors")


def _scores(df):
    return df.withColumns({c: F.round(c, 9) for c in ("distance", "similarity_score") if c in df.columns})


def embed_batch(spark, folder):
    """Unit vectors of whole issue texts; their non-zero components."""
    vectors = embed_issues(view(spark, folder, "issues"))
    parts = vectors.select("issue_number", F.posexplode("embedding").alias("pos", "x")).filter("x <> 0")
    return parts.select("issue_number", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


def embed_tfidf(spark, folder):
    """Fitted TF-IDF vectors of whole issue texts; their components that aren't zero."""
    issues = view(spark, folder, "issues")
    texts = issues.select("repo_name", "issue_number", combine_text(F.col("title"), F.col("body")).alias("text"))
    vectors = fitted_vectors(texts, ["repo_name", "issue_number"])
    parts = vectors.select("issue_number", F.posexplode("embedding").alias("pos", "x"))
    return parts.select("issue_number", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), 5).alias("x")).filter("x <> 0")


def non_empty_text(spark, folder):
    """Turns of the assistant are blanked, which makes them unfit for embedding."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").withColumn(
        "text", F.when(F.col("role") == "assistant", F.lit("  \n")).otherwise(F.col("text")))
    good, bad = V.split_valid(turns, [V.text_check("text")])
    return good.select("conv_id", "turn", F.lit("").alias("reason")).unionByName(bad.select("conv_id", "turn", "reason"))


def knn_topk(spark, folder):
    vectors = _vectors(spark, folder)
    return _scores(N.knn_topk(vectors, vectors, 3))


def knn_rank(spark, folder):
    """Ten matches, searched block by block with pivots."""
    vectors = _vectors(spark, folder)
    return N.knn_topk(vectors, vectors, 10, exclude_self=True, n_clusters=4, block_rows=200).select(
        "repo_name", "query_number", "match_number", "rnk")


TABLES, HASHES, WIDTH = 16, 3, 0.25  # the given vectors are nearly orthogonal: fewer tables find less than 0.9 of the matches


def ann_join(spark, folder):
    """Hash tables over random projections."""
    vectors = _vectors(spark, folder)
    return _scores(lsh.ann_join(vectors, vectors, 3, tables=TABLES, hashes=HASHES, width=WIDTH, exclude_self=True))


def ann_join_full_probe(spark, folder):
    """All clusters probed: the same as the exact search."""
    vectors = _vectors(spark, folder)
    return _scores(N.probe_join(vectors, vectors, 3, n_clusters=8, n_probe=8, exclude_self=True, min_similarity=0.3))


def repo_filter(spark, folder):
    return T.of_repo(_vectors(spark, folder), "repo1").select("repo_name", "issue_number")


def similarity_threshold(spark, folder):
    vectors = _vectors(spark, folder)
    found = _scores(N.knn_topk(vectors, vectors, 3, exclude_self=True))
    return found.filter(N.reaches_threshold(F.col("similarity_score"), THRESHOLD)).select("repo_name", "query_number", "match_number")


def _verdicts(spark, folder):
    vectors = _vectors(spark, folder)
    return N.duplicate_decision(vectors, vectors, THRESHOLD)


def duplicate_decision(spark, folder):
    return _scores(_verdicts(spark, folder))


def find_duplicates(spark, folder):
    """From issue texts to verdicts."""
    return D.find_duplicates(view(spark, folder, "issues")).withColumn("similarity_score", F.round("similarity_score", 6))


def _pr_payloads(spark, folder):
    text = joined_messages(view(spark, folder, "commit_messages"))
    title = F.concat(F.lit("change "), F.col("pr_number").cast("string"))
    return text.select(F.lit("chat").alias("repo_name"), F.col("pr_number").alias("issue_number"), title.alias("title"),
                       pr_payload(title, F.col("messages"), F.lit("")).alias("payload"))


def pr_duplicate_decision(spark, folder):
    found = D.find_pr_duplicates(_pr_payloads(spark, folder), exclude_self=True)
    return found.withColumn("similarity_score", F.round("similarity_score", 6))


def triage_actions(spark, folder):
    return actions(_verdicts(spark, folder), "issue", "Bot: ").unionByName(
        actions(_verdicts(spark, folder), "pull_request")).withColumn("message", F.coalesce("message", F.lit("-")))


def match_message(spark, folder):
    vectors = _vectors(spark, folder)
    best = N.knn_topk(vectors, vectors, 1, exclude_self=True)
    return best.select("repo_name", "query_number", message_text(F.col("match_number"), F.round("similarity_score", 9)).alias("message"))


def _changes(spark, folder):
    """New titles for every vector with an odd label, one in three of them without document."""
    return _vectors(spark, folder).filter("label in (1, 3, 5, 7, 9)").select(
        "repo_name", "issue_number", F.concat(F.lit("new "), "title").alias("title"), "embedding",
        F.when(F.col("label") != 3, F.concat(F.lit("doc "), "title")).alias("document"))


def _stored(spark, folder):
    path = work_path(spark, "vectors")
    T.ensure_table(spark, path)
    first = _vectors(spark, folder).withColumn("document", F.col("title"))
    T.upsert(first, path, 64, version=1)
    return path


_STORED = ["id", "repo_name", "issue_number", "title", "document", "version"]


def vector_upsert(spark, folder):
    """Written, overwritten in part, compacted, and overwritten again with the same rows."""
    path = _stored(spark, folder)
    T.upsert(_changes(spark, folder), path, 64, version=2)
    path = T.compact(spark, path, work_path(spark, "vectors"))
    T.upsert(_changes(spark, folder), path, 64, version=2)
    return T.current(spark, path).select(*_STORED, F.size("embedding").cast("bigint").alias("dimension"))


def vector_upsert_batch(spark, folder):
    """Parallel arrays, one record per label; label 4 has one title too few and is rejected."""
    rows = F.array_sort(F.collect_list(F.struct("issue_number", "repo_name", "title", "embedding")))
    arrays = _vectors(spark, folder).groupBy("label").agg(rows.alias("rows")).select(
        "label", F.col("rows.repo_name").alias("repo_name"), F.col("rows.issue_number").alias("issue_number"),
        F.when(F.col("label") == 4, F.slice("rows.title", 1, F.size("rows") - 1)).otherwise(F.col("rows.title")).alias("title"),
        F.col("rows.embedding").alias("embedding"))
    path = work_path(spark, "vectors")
    T.ensure_table(spark, path)
    T.upsert_arrays(arrays, path, 64, version=1)
    return T.current(spark, path).select("id", "title")


def ensure_vector_table(spark, folder):
    """The table is made, filled and asked for again, which leaves it alone: what it holds per label."""
    path = work_path(spark, "vectors")
    for _ in range(2):
        T.ensure_table(spark, path)
    T.upsert(_vectors(spark, folder).withColumn("title", F.concat_ws("/", "title", "label")), path, 64)
    T.ensure_table(spark, path)
    label = F.split("title", "/")[1].cast("int").alias("label")
    return T.current(spark, path).groupBy("repo_name", label).agg(F.count(F.lit(1)).alias("rows"), F.sum("issue_number").alias("numbers"))


def latest_version(spark, folder):
    first = T.vector_rows(_vectors(spark, folder).withColumn("document", F.col("title")), 1)
    return T.latest_version(first.unionByName(T.vector_rows(_changes(spark, folder), 2))).select(*_STORED)


def stored_repo_search(spark, folder):
    """Search in one repository of a stored table."""
    found = T.current(spark, _stored(spark, folder), repo="repo2")
    return _scores(N.knn_topk(found, found, 3))


def _flawed(spark, folder):
    """Vectors with one flaw per label."""
    label = F.col("label")
    return _vectors(spark, folder).select(
        F.col("issue_number").alias("row"),
        F.when(label == 1, F.lit(" \t")).otherwise(F.col("repo_name")).alias("repo_name"),
        F.when(label == 2, -F.col("issue_number")).when(label == 3, F.lit(0)).otherwise(F.col("issue_number")).alias("issue_number"),
        F.when(label == 4, F.lit(" ")).when(label == 5, F.lit(None)).otherwise(F.col("title")).alias("title"),
        F.when(label == 6, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"))


def _judged(df, checks):
    good, bad = V.split_valid(df, checks)
    return good.select("row", F.lit("").alias("reason")).unionByName(bad.select("row", "reason"))


def valid_metadata(spark, folder):
    return _judged(_flawed(spark, folder), V.metadata_checks())


def valid_dimension(spark, folder):
    return _judged(_flawed(spark, folder), [V.dimension_check(64)])


def valid_issue(spark, folder):
    return _judged(_flawed(spark, folder), V.issue_checks())


def valid_results(spark, folder):
    """Value ranges and allowed names of classifier results, on order lines."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus") == "F").alias("is_duplicate"),
        (F.col("l_quantity") / 45.0).alias("confidence"),
        F.when(F.col("l_linenumber") == 1, F.lit("same_bug")).when(F.col("l_linenumber") == 2, F.lit("unclear"))
        .otherwise(F.lit("other")).alias("duplicate_type"),
        F.when(F.col("l_tax") != 0.01, F.lit(False)).alias("needs_review"), F.when(F.col("l_tax") != 0.02, F.lit("r")).alias("reason"))
    return _judged(lines, V.classification_checks())


def valid_verdicts(spark, folder):
    """Score ranges of duplicate verdicts, on order lines."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"),
        (F.col("l_returnflag") == "R").alias("is_duplicate"), (F.col("l_quantity") / 45.0 - 0.1).alias("similarity_score"),
        F.when(F.col("l_linenumber") < 4, F.col("l_orderkey")).alias("duplicate_of_number"))
    return _judged(lines, V.verdict_checks())


def valid_requests(spark, folder):
    """Fields of review requests and scores of reviewers, on order lines."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"),
        F.when(F.col("l_linenumber") == 1, F.lit(" ")).otherwise(F.col("l_returnflag")).alias("repo_name"),
        F.when(F.col("l_linenumber") != 2, F.col("l_orderkey")).alias("pr_number"),
        F.when(F.col("l_linenumber") != 3, F.lit("a")).alias("author_username"), F.lit("b").alias("author"),
        (F.col("l_quantity") - 5).alias("relevance_score"))
    return _judged(lines, [*V.request_checks(), *V.reviewer_checks()])


def aligned_arrays(spark, folder):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    talks = spark.read.parquet(f"{folder}/conversations.parquet").groupBy("conv_id").agg(turns.alias("t"))
    uneven = F.col("conv_id").cast("string").endswith("5")
    arrays = talks.select("conv_id", F.col("t.role").alias("role"),
                          F.when(uneven, F.slice("t.text", 2, 100)).otherwise(F.col("t.text")).alias("text"))
    rows, bad = V.zip_aligned(arrays, ["role", "text"], ["conv_id"])
    return rows.select("conv_id", "role", F.md5("text").alias("text"), F.lit("").alias("reason")).unionByName(
        bad.select("conv_id", F.lit("").alias("role"), F.lit("").alias("text"), "reason"))


def required_columns(spark, folder):
    """Only the tables that have all the columns take part."""
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("orders", "customer", "documents")]
    fit = [t for t in tables if V.has_columns(t, ["c_custkey", "c_name"])]
    out = fit[0].select("c_custkey", "c_name")
    for table in fit[1:]:
        out = out.unionByName(table.select("c_custkey", "c_name"))
    return out


def param_checks(spark, folder):
    """Bad parameters are refused while the plan is built, before any row is read."""
    vectors, refused = _vectors(spark, folder), 0
    for attempt in (lambda: N.knn_topk(vectors, vectors, 0), lambda: T.of_repo(vectors, " "),
                    lambda: N.duplicate_decision(vectors, vectors, 1.5), lambda: lsh.ann_join(vectors, vectors, -1, tables=4, hashes=1, width=1.0)):
        try:
            attempt()
        except ValueError:
            refused += 1
    return vectors.groupBy("repo_name").agg(F.count(F.lit(1)).alias("rows"), F.lit(refused).cast("bigint").alias("refused"))


QUERIES = {f.__name__: f for f in (
    embed_batch, embed_tfidf, non_empty_text, knn_topk, knn_rank, ann_join, ann_join_full_probe, repo_filter, similarity_threshold,
    duplicate_decision, find_duplicates, pr_duplicate_decision, triage_actions, match_message, vector_upsert,
    vector_upsert_batch, ensure_vector_table, latest_version, stored_repo_search, valid_metadata, valid_dimension,
    valid_issue, valid_results, valid_verdicts, valid_requests, aligned_arrays, required_columns, param_checks)}


def hashed_sql(source: str, key: str, text: str) -> str:
    """CTE ``units(key, at, x)``: the bundled model's vectors, non-zero components only."""
    return f"""
    toks as (select {key}, unnest(regexp_extract_all(lower({text}), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+')) as tok from {source}),
    parts as (select {key}, cast(('0x' || substring(md5(tok), 1, 8)) as bigint) % 256 as at,
                     sum(case when substring(md5(tok), 9, 1) < '8' then 1 else -1 end) as x from toks group by all having x <> 0),
    lens as (select {key}, sqrt(sum(x * x)) as len from parts group by all),
    units as (select parts.*  replace (cast(cast(x / len as float) as double) as x) from parts join lens using ({key})),
    norms as (select {key}, sqrt(sum(x * x)) as norm from units group by all)"""


def best_sql(source: str, condition: str, threshold: str = "0.85") -> str:
    """Verdicts from ``units``: best match of every row of ``source`` by cosine, then by number."""
    return f"""
    sims as (select q.repo_name, q.issue_number, v.issue_number as other,
                    round(coalesce(d.dot, 0) / (nq.norm * nv.norm), 9) + 0.0 as sim
             from {source} q join {source} v on q.repo_name = v.repo_name and {condition}
             join norms nq on nq.repo_name = q.repo_name and nq.issue_number = q.issue_number
             join norms nv on nv.repo_name = v.repo_name and nv.issue_number = v.issue_number
             left join (select a.repo_name, a.issue_number as n1, b.issue_number as n2, sum(a.x * b.x) as dot
                        from units a join units b on a.repo_name = b.repo_name and a.at = b.at group by all) d
               on d.repo_name = q.repo_name and d.n1 = q.issue_number and d.n2 = v.issue_number),
    best as (select * from sims qualify row_number() over (partition by repo_name, issue_number order by sim desc, other) = 1),
    verdicts as (select s.repo_name, s.issue_number, coalesce(greatest(b.sim, 0) >= {threshold}, false) as is_duplicate,
             greatest(coalesce(b.sim, 0), 0) as similarity_score,
             case when greatest(b.sim, 0) >= {threshold} then b.other end as duplicate_of_number
             from {source} s left join best b on b.repo_name = s.repo_name and b.issue_number = s.issue_number)"""


def _near(extra: str, limit: int, where: str = "true") -> str:
    return f"""+n as (select q.repo_name, q.issue_number as query_number, v.issue_number as match_number, v.title,
            round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 9) as sim
            from vectors q join vectors v on q.repo_name = v.repo_name and {extra} where {where}),
        r as (select *, row_number() over (partition by repo_name, query_number order by sim desc, match_number) as rnk from n
              qualify rnk <= {limit})"""


_OTHER = "q.issue_number <> v.issue_number"
_KNN_COLUMNS = """repo_name, query_number, match_number, title, round(1 - sim, 9) as distance,
    round(greatest(cast(0 as double), least(cast(1 as double), sim)), 9) as similarity_score, rnk"""
_DECIDED = _near(_OTHER, 1) + f""", v1 as (select v.repo_name, v.issue_number, greatest(coalesce(r.sim, 0), 0) as score, r.match_number
    from vectors v left join r on r.repo_name = v.repo_name and r.query_number = v.issue_number),
    d as (select repo_name, issue_number, score >= {THRESHOLD} and match_number is not null as is_duplicate, round(score, 9) as similarity_score,
          case when score >= {THRESHOLD} then match_number end as duplicate_of_number from v1)"""
_FLAWED = """+f as (select issue_number as row, label, case when label = 1 then ' ' || chr(9) else repo_name end as repo_name,
    case when label = 2 then -issue_number when label = 3 then 0 else issue_number end as issue_number from vectors)"""
_EMPTY_REPO, _EMPTY_TITLE = "'repo_name: blank'", "'title: blank'"
_MERGED = """+m as (select repo_name || '#' || issue_number as id, repo_name, issue_number,
    case when label % 2 = 1 then 'new ' || title else title end as title,
    case when label % 2 = 1 and label <> 3 then 'doc ' || title else title end as document,
    cast(case when label % 2 = 1 then 2 else 1 end as bigint) as version, len(embedding) as dimension from vectors)"""
_ISSUE_TEXT = f"""+t as (select repo_name, issue_number, {trim_sql('title')} || chr(10) || {trim_sql("coalesce(body, '')")} as text from issues)"""
_PR_TEXT = f"""+j as (select pr_number, string_agg(message, ' ' order by pos) as messages from commit_messages group by 1),
    t as (select 'chat' as repo_name, pr_number as issue_number,
          'TITLE: change ' || pr_number || ' | COMMITS: ' || {clean_sql('messages')} || ' | DESCRIPTION: ' as text from j)"""
_VERDICT_COLUMNS = "repo_name, issue_number, is_duplicate, round(similarity_score, 6) as similarity_score, duplicate_of_number"
_RK = "repo_name, issue_number"

SQL = {
    "embed_batch": with_views("issues", _ISSUE_TEXT + "," + hashed_sql("t", _RK, "text") + """
        select issue_number, units.at as pos, round(x, 6) as x from units"""),
    "embed_tfidf": with_views("pairs", """+hashed as (
            select repo, issue_number, cast(('0x' || substring(md5(word), 1, 8)) as bigint) % 256 as pos,
                   sum(case when substring(md5(word), 9, 1) < '8' then w else -w end) as x from raw group by all),
        scaled as (select issue_number, pos, round(cast(cast(x / sqrt(sum(x * x) over (partition by repo, issue_number)) as float) as double), 5) as x from hashed)
        select issue_number, pos, x from scaled where x <> 0"""),
    "non_empty_text": """select conv_id, turn, case when role = 'assistant' then 'text: blank' else '' end as reason from conversations""",
    "knn_topk": with_views("vectors", _near("true", 3) + f" select {_KNN_COLUMNS} from r"),
    "knn_rank": with_views("vectors", _near(_OTHER, 10) + " select repo_name, query_number, match_number, rnk from r"),
    "ann_join": with_views("vectors", f"""+x as (
            select repo_name, issue_number, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i, len(embedding) as dimension from vectors),
        norms as (select repo_name, issue_number, sqrt(sum(cast(x as double) * x)) as norm from x group by all),
        draws as (select t, j, i, case when substring(md5(concat(t, '|', j, '|', i)), 1, 1) < '8' then 1 else -1 end as sign,
                         cast(('0x' || substring(md5(concat(t, '|', j)), 1, 8)) as bigint) / cast(4294967296 as double) as begun
                  from range({TABLES}) tables(t), range({HASHES}) hashes(j), (select distinct i from x)),
        steps as (select repo_name, issue_number, t, j, cast(floor(sum(x / norm * sign) / sqrt(any_value(dimension)) / {WIDTH}
                         + any_value(begun)) as bigint) as step
                  from x join norms using (repo_name, issue_number) join draws using (i) group by all),
        buckets as (select repo_name, issue_number, t, string_agg(step, ',' order by j) as bucket from steps group by all),
        met as (select distinct a.repo_name, a.issue_number as query_number, b.issue_number as match_number
                from buckets a join buckets b using (repo_name, t, bucket) where a.issue_number <> b.issue_number),
        n as (select m.*, v.title, round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 9) as sim
              from met m join vectors q on q.repo_name = m.repo_name and q.issue_number = m.query_number
              join vectors v on v.repo_name = m.repo_name and v.issue_number = m.match_number),
        r as (select *, row_number() over (partition by repo_name, query_number order by sim desc, match_number) as rnk from n qualify rnk <= 3)
        select {_KNN_COLUMNS} from r"""),
    "ann_join_full_probe": with_views("vectors", _near(_OTHER, 3) + f" select {_KNN_COLUMNS} from r where sim >= 0.3"),
    "repo_filter": with_views("vectors", "select repo_name, issue_number from vectors where repo_name = 'repo1'"),
    "similarity_threshold": with_views("vectors", _near(_OTHER, 3) + f" select repo_name, query_number, match_number from r where sim >= {THRESHOLD}"),
    "duplicate_decision": with_views("vectors", _DECIDED + " select * from d"),
    "find_duplicates": with_views("issues", _ISSUE_TEXT + "," + hashed_sql("t", _RK, "text") + ","
                                  + best_sql("t", _OTHER) + f" select {_VERDICT_COLUMNS} from verdicts"),
    "pr_duplicate_decision": with_views("commit_messages", _PR_TEXT + "," + hashed_sql("t", _RK, "text") + ","
                                        + best_sql("t", _OTHER) + f" select {_VERDICT_COLUMNS} from verdicts"),
    "triage_actions": with_views("vectors", _DECIDED + """, steps as (
        select *, 'Bot: Duplicate of #' as lead from d union all select *, 'PR appears to duplicate #' from d)
        select repo_name, issue_number as number, 1 as step, 'comment' as action,
               lead || duplicate_of_number || ' (' || cast(round(similarity_score * 100) as bigint) || '% match).' as message
        from steps where is_duplicate
        union all select repo_name, issue_number, 2, 'close', '-' from steps where is_duplicate"""),
    "match_message": with_views("vectors", _near(_OTHER, 1) + """
        select repo_name, query_number, 'Duplicate of #' || match_number || ' ('
               || cast(round(greatest(sim, 0) * 100) as bigint) || '% match).' as message from r"""),
    "vector_upsert": with_views("vectors", _MERGED + " select * from m"),
    "vector_upsert_batch": with_views("vectors", "select repo_name || '#' || issue_number as id, title from vectors where label <> 4"),
    "ensure_vector_table": with_views("vectors", """
        select repo_name, label, count(*) as "rows", cast(sum(issue_number) as bigint) as numbers from vectors group by all"""),
    "latest_version": with_views("vectors", _MERGED + " select * exclude (dimension) from m"),
    "stored_repo_search": with_views("vectors", _near("true", 3, "q.repo_name = 'repo2'") + f" select {_KNN_COLUMNS} from r"),
    "valid_metadata": with_views("vectors", _FLAWED + f"""
        select row, case when label = 1 then {_EMPTY_REPO} when label in (4, 5) then {_EMPTY_TITLE}
               when issue_number <= 0 then 'issue_number: not above 0' else '' end as reason from f"""),
    "valid_dimension": with_views("vectors", _FLAWED + """
        select row, case when label = 6 then 'embedding: not 64 numbers' else '' end as reason from f"""),
    "valid_issue": with_views("vectors", _FLAWED + """
        select row, case when label = 1 then 'repo_name' when label in (4, 5) then 'title' else '' end as reason from f"""),
    "valid_results": """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row,
        case when l_returnflag = 'N' then 'is_duplicate' when l_quantity / 45 > 1 then 'confidence'
             when l_linenumber > 2 then 'duplicate_type' when l_tax = 0.01 then 'needs_review' when l_tax = 0.02 then 'reason'
             else '' end as reason from lineitem""",
    "valid_verdicts": """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row,
        case when l_quantity / 45 - 0.1 not between 0 and 1 then 'similarity_score'
             when l_returnflag = 'R' and l_linenumber >= 4 then 'duplicate_of_number' else '' end as reason from lineitem""",
    "valid_requests": """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row,
        case l_linenumber when 1 then 'repo_name' when 2 then 'pr_number' when 3 then 'author_username'
             else case when l_quantity < 5 then 'relevance_score' else '' end end as reason from lineitem""",
    "aligned_arrays": """select conv_id, role, md5(text) as text, '' as reason from conversations where conv_id % 10 <> 5
        union all select distinct conv_id, '', '', 'arrays: unequal lengths' from conversations where conv_id % 10 = 5""",
    "required_columns": "select c_custkey, c_name from customer",
    "param_checks": with_views("vectors", 'select repo_name, count(*) as "rows", cast(4 as bigint) as refused from vectors group by 1'),
}
