"""Issue dumps, pair corpus, resume, and the labelling cascade."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from catalog.inputs import view, with_views
from catalog.text import normalize_sql
from reposift.functions import text as X
from reposift.operators import cascade as C
from reposift.operators import neighbours as N
from reposift.operators import pairs as P
from reposift.operators import text_classifier as TC
from reposift.operators.embedding import embed_texts
from reposift.plans import labelling
from reposift.session import work_path
from reposift.sinks import pair_tables as S
from reposift.sources import issues as I
from reposift.sources import pairs as SP

KEY = SP.PAIR_KEY


def _dump(spark, folder, path=None):
    """The issues written as JSON dumps, one folder per repository."""
    path = path or work_path(spark, "dumps")
    raw = view(spark, folder, "issues").withColumnRenamed("issue_number", "number")
    raw.withColumn("part", F.col("repo_name")).write.partitionBy("part").json(path)
    return path


BLOCK = 200  # numbers of a block of the query on blocks of issue numbers
NEWEST, CAP = 30, 7  # limits of the two queries whose feature is a limit


def _pairs(spark, folder, with_text=True):
    """Alike issues of a repository, wherever their numbers lie."""
    return P.similar_pairs(view(spark, folder, "issues"), with_text=with_text)


def scored(spark, folder):
    """Each vector with its ten best matches; the shift spreads scores over the thresholds in use."""
    vectors = view(spark, folder, "vectors")
    found = N.knn_topk(vectors, vectors, 10, exclude_self=True)
    labels = vectors.select("repo_name", "issue_number", "label")
    found = (
        found.join(labels.withColumnsRenamed({"issue_number": "query_number", "label": "q"}), ["repo_name", "query_number"])
        .join(labels.withColumnsRenamed({"issue_number": "match_number", "label": "v"}), ["repo_name", "match_number"])
    )
    same = F.col("q") == F.col("v")
    raised = F.lit(0.15) + F.when(same, F.lit(0.15)).otherwise(F.lit(0.0)) + (F.lit(1.0) - F.col("distance"))
    return found.select(
        F.col("repo_name").alias("repo"), F.col("query_number").alias("issue_1_number"),
        F.col("match_number").alias("issue_2_number"), F.when(same, F.lit(1)).otherwise(F.lit(0)).alias("true_label"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raised)), 9).alias("cosine_similarity"))


def progress(spark, folder):
    total = F.pmod(F.col("issue_1_number") + F.col("issue_2_number"), F.lit(3))
    return scored(spark, folder).filter("true_label = 1").select(
        *KEY, F.when(total == 0, F.lit("1")).when(total == 1, F.lit("0")).otherwise(F.lit(" ")).alias("is_duplicate"),
        (F.pmod(F.col("issue_1_number") * 13, F.lit(100)) / F.lit(100.0)).alias("final_confidence"))


# --- sources

def scan_issues(spark, folder):
    return I.read_issues(spark, _dump(spark, folder)).select("repo_name", "issue_number", "title", "body")


def issues_per_repo_cap(spark, folder):
    return I.cap_per_repo(view(spark, folder, "issues"), CAP).select("repo_name", "issue_number", "pos")


def scan_multi_repo(spark, folder):
    """All dumps plus one that holds broken records, one that isn't there and one whose packed file breaks off."""
    path = _dump(spark, folder)
    broken, cut = work_path(spark, "broken"), work_path(spark, "cut")
    view(spark, folder, "issues").filter("repo_name = 'src1'").select(
        F.concat(F.lit('{"number": '), F.col("issue_number").cast("string")).alias("value")).write.text(broken)
    S.put_file(spark, f"{cut}/part.json.gz", gzip.compress(b'{"repo_name": "src1", "number": 1}\n' * 5000)[:-40])
    dumps = I.read_issue_dumps(spark, [path, broken, f"{path}/part=absent", cut])
    failed = dumps.failed.select(F.element_at(F.split("path", "/"), -1).alias("repo_name"), F.lit(0).cast("bigint").alias("issues"), F.col("reason").alias("kind"))
    return (
        dumps.issues.groupBy("repo_name").agg(F.count(F.lit(1)).alias("issues")).withColumn("kind", F.lit("read"))
        .unionByName(dumps.broken.agg(F.count(F.lit(1)).alias("issues")).withColumns({"kind": F.lit("broken"), "repo_name": F.lit("")}))
        .unionByName(failed)
    )


def scan_pairs_csv(spark, folder):
    path = S.write_pairs(_pairs(spark, folder).drop("cosine_similarity"), work_path(spark, "pairs-csv"), "csv")
    back = SP.read_pairs_csv(spark, path)
    return back.select(*KEY, F.md5(F.concat_ws("|", "issue_1_text", "issue_2_text")).alias("texts"),
                       F.coalesce("is_duplicate", F.lit("")).alias("is_duplicate"))


def scan_progress(spark, folder):
    """The primary path lacks a column and is ignored; then the fallback alone is there."""
    rows = progress(spark, folder)
    incomplete, whole = work_path(spark, "progress"), work_path(spark, "progress")
    rows.drop("final_confidence").write.parquet(incomplete)
    rows.write.parquet(whole)
    none = SP.read_progress(spark, incomplete, whole)
    return none.unionByName(SP.read_progress(spark, incomplete + "-absent", whole))


# --- pairs

def repo_pairs(spark, folder):
    return P.repo_pairs(view(spark, folder, "issues"), NEWEST, with_text=False)


def block_pairs(spark, folder):
    """All pairs of issues with near numbers, alike or not."""
    return P.block_pairs(view(spark, folder, "issues"), BLOCK, with_text=False)


def block_counts(spark, folder):
    return P.pair_counts(view(spark, folder, "issues"), BLOCK)


def unique_issues(spark, folder):
    """Texts differ from pair to pair here, so the first one has to be found."""
    marked = _pairs(spark, folder, with_text=False).withColumns({
        "issue_1_text": F.concat_ws("/", "issue_1_number", "issue_2_number"),
        "issue_2_text": F.concat_ws("\\", "issue_2_number", "issue_1_number")})
    return P.unique_issues(P.unpivot_pairs(marked))


def issue_table(spark, folder):
    return P.issue_table(_pairs(spark, folder, with_text=False), P.issue_texts(view(spark, folder, "issues")))


def _pair_vectors(spark, folder):
    """Vectors of the issues themselves, so that no text is copied into pairs first."""
    issues = view(spark, folder, "issues").select(
        F.col("repo_name").alias("repo"), "issue_number", X.normalize_text(X.combine_text(F.col("title"), F.col("body"))).alias("issue_text"))
    return embed_texts(issues, "issue_text")[0].select("repo", "issue_number", "embedding")


def pair_embeddings(spark, folder):
    """Both vectors of every pair, told by sums and by weighted sums; those of one repository are left out and stay null."""
    vectors = _pair_vectors(spark, folder).filter("repo <> 'src3'")
    met = P.pair_embeddings(_pairs(spark, folder, with_text=False), vectors)

    def told(n):
        weighted = F.aggregate(F.transform(f"embedding_{n}", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
        return F.round(weighted, 4).alias(f"weighted_{n}")

    return met.select(*KEY, told(1), told(2))


def missing_vectors(spark, folder):
    """Keys without a vector, once each."""
    vectors = _pair_vectors(spark, folder).filter("repo <> 'src3'")
    return P.missing_vectors(P.pair_embeddings(_pairs(spark, folder, with_text=False), vectors))


def pair_cosine(spark, folder):
    """Every vector against its ten best matches, through two key look-ups."""
    vectors = view(spark, folder, "vectors").withColumnRenamed("repo_name", "repo")
    met = P.score_pairs(scored(spark, folder).drop("cosine_similarity"), vectors)
    return met.select(*KEY, F.round("cosine_similarity", 9).alias("cosine_similarity"))


def scored_pair_corpus(spark, folder):
    """Every pair of alike issues of a repository, with its score."""
    met = _pairs(spark, folder, with_text=False)
    return met.select(*KEY, F.round("cosine_similarity", 6).alias("cosine_similarity"))


def merge_progress(spark, folder):
    table = scored(spark, folder).withColumn("is_duplicate", F.when(F.col("cosine_similarity") > 0.6, F.lit("x")))
    return P.merge_progress(table, progress(spark, folder)).select(*KEY, "is_duplicate", "final_confidence")


def resume_antijoin(spark, folder):
    return P.unlabelled(scored(spark, folder), progress(spark, folder)).select(*KEY)


def already_labelled(spark, folder):
    return progress(spark, folder).filter(P.is_labelled(F.col("is_duplicate"))).select(*KEY)


def counts(spark, folder):
    """Issues of each repository, all of their pairs, and how many of those are alike."""
    issues = view(spark, folder, "issues")
    alike = P.similar_counts(issues, _pairs(spark, folder, with_text=False))
    alike = alike.select(F.col("repo_name").alias("of"), F.col("pairs").alias("alike"))
    return P.whole_counts(issues).join(alike, F.col("repo_name").eqNullSafe(F.col("of"))).drop("of")


def coerce_pair_types(spark, folder):
    raw = _pairs(spark, folder).withColumn(
        "cosine_similarity", F.when((F.col("issue_1_number") + F.col("issue_2_number")) % 7 == 3, F.lit("?")).otherwise(F.lit("0.5")))
    typed, bad = P.coerce_pair_types(raw)
    kept = typed.select(*KEY, F.md5(F.concat_ws("|", "issue_1_text", "issue_2_text")).alias("texts"), "cosine_similarity")
    return kept.unionByName(bad.select(*KEY, F.lit("bad").alias("texts"), F.lit(None).cast("double").alias("cosine_similarity")))


# --- sinks

def write_pairs(spark, folder):
    path = S.write_pairs(_pairs(spark, folder), work_path(spark, "pairs"))
    return spark.read.parquet(path).select(
        *KEY, F.length("issue_1_text").cast("bigint").alias("chars_1"), "is_duplicate")


def write_scored_pairs(spark, folder):
    path = S.write_pairs(scored(spark, folder), work_path(spark, "new/parents/scored"), "csv")
    return _read_scored(spark, path)


def _read_scored(spark, path):
    raw = SP.csv_reader(spark).csv(path)
    return raw.select("repo", *[F.col(c).cast("bigint").alias(c) for c in KEY[1:]],
                      F.col("cosine_similarity").cast("double").alias("cosine_similarity"))


def write_labelled_pairs(spark, folder):
    table = _pairs(spark, folder).withColumns({
        "issue_1_text": F.concat(F.lit("="), "issue_1_text"), "scratch": F.lit(1),
        "final_confidence": F.lit(0.25), "cosine_similarity": F.lit(0.5)})
    path = S.write_labelled_pairs(table, work_path(spark, "labelled"))
    back = SP.csv_reader(spark).csv(path)
    return back.select("repo", *[F.col(c).cast("bigint").alias(c) for c in KEY[1:]],
                       F.md5("issue_1_text").alias("text_1"), "final_confidence",
                       F.lit(",".join(back.columns)).alias("columns"))


def write_with_fallback(spark, folder):
    """A plain file stands where the first path's folder should be, so storage refuses to write there; the rows arrive at the second."""
    blocked, second = work_path(spark, "blocked"), work_path(spark, "fallback")
    S.put_file(spark, blocked)
    rows = scored(spark, folder)
    used = S.write_with_fallback(lambda path: S.write_pairs(rows, path), f"{blocked}/denied", second)
    return spark.read.parquet(used).select(*KEY, F.lit(used == second).alias("fell_back"))


# --- cascade

def first_scorer(pairs):
    """Deterministic stand-in for the first model."""
    n1, n2 = F.col("issue_1_number"), F.col("issue_2_number")
    duplicate = F.col("cosine_similarity") >= 0.6
    return pairs.withColumns({
        "is_duplicate": duplicate, "confidence": F.pmod(n1 * 31 + n2 * 17, F.lit(100)) / F.lit(100.0),
        "needs_review": F.pmod(n1 + n2, F.lit(11)) == 0,
        "duplicate_type": F.when(duplicate, F.lit("same_bug")).otherwise(F.lit("not_duplicate")), "reason": F.lit("first"),
        "matching_signals": F.array(F.lit("m")), "difference_signals": F.array(F.lit("d"))})


def second_scorer(pairs):
    n1, n2 = F.col("issue_1_number"), F.col("issue_2_number")
    duplicate = F.col("cosine_similarity") >= 0.55
    return pairs.withColumns({
        "is_duplicate": duplicate, "confidence": F.pmod(n1 * 13 + n2 * 7, F.lit(100)) / F.lit(100.0),
        "duplicate_type": F.when(duplicate, F.lit("same_bug")).otherwise(F.lit("not_duplicate")),
        "agree_with_first_pass": duplicate == F.col("pass_1_is_duplicate"), "final_route": F.lit("auto_label"),
        "reason": F.lit("second"), "duplicate_evidence": F.array(F.lit("e")), "non_duplicate_evidence": F.array(F.lit("n"))})


def first_pandas(pdf):
    """The first scorer once more, as a pandas function."""
    import pandas as pd

    n1, n2 = pdf["issue_1_number"], pdf["issue_2_number"]
    duplicate = pdf["cosine_similarity"] >= 0.6
    return pd.DataFrame({
        "is_duplicate": duplicate, "confidence": ((n1 * 31 + n2 * 17) % 100) / 100.0, "needs_review": (n1 + n2) % 11 == 0,
        "duplicate_type": duplicate.map({True: "same_bug", False: "not_duplicate"}), "reason": "first",
        "matching_signals": [["m"]] * len(pdf), "difference_signals": [["d"]] * len(pdf)})


def _by_value(fn):
    """Workers needn't have this module: the function travels with its code."""
    import types

    return types.FunctionType(fn.__code__, {"__builtins__": __builtins__}, fn.__name__)


def _flaky_first():
    plain = _by_value(first_pandas)

    def flaky(pdf):
        if ((pdf["issue_1_number"] + pdf["issue_2_number"]) % 97 == 0).any():
            raise ValueError("no answer")
        return plain(pdf)

    return flaky


def llm_gate(spark, folder):
    return scored(spark, folder).select(*KEY, C.needs_classifier(F.col("cosine_similarity")).alias("classify"))


def second_check_needed(spark, folder):
    judged = first_scorer(scored(spark, folder))
    return judged.select(*KEY, C.second_check_needed(
        F.col("is_duplicate"), F.col("confidence"), F.col("needs_review")).alias("again"))


def classify_pairs(spark, folder):
    """A pandas classifier on Arrow batches; rows it fails on carry the error."""
    run = C.pandas_classifier(_flaky_first(), C.FIRST_RESULT, on_error="review")
    return run(scored(spark, folder)).select(
        *KEY, "is_duplicate", "confidence", "needs_review", "duplicate_type", F.coalesce("error", F.lit("")).alias("error"))


_TRAIL = ["is_duplicate", "confidence", "needs_review", "duplicate_type", "reason", "pass_1_is_duplicate",
          "pass_1_confidence", "pass_1_needs_review", "second_check_ran", "verifier_agree_with_first_pass",
          "verifier_final_route"]


def cascade(spark, folder):
    return C.cascade(scored(spark, folder), first_scorer, second_scorer).select(*KEY, *_TRAIL)


def classify_texts(spark, folder):
    """The bundled first pass on the texts of alike issues."""
    told = TC.first_pass(_pairs(spark, folder))
    return told.select(*KEY, "is_duplicate", F.round("confidence", 9).alias("confidence"), "needs_review", "duplicate_type", "reason",
                       *[F.array_join(c, "|").alias(c) for c in ("matching_signals", "difference_signals")])


def text_cascade(spark, folder):
    """Both bundled passes on the texts of alike issues; those below 0.5 aren't classified."""
    outcome = C.cascade(_pairs(spark, folder), TC.first_pass, TC.second_pass, minimum=0.5)
    return outcome.select(*KEY, *_TRAIL).withColumns({c: F.round(c, 9) for c in ("confidence", "pass_1_confidence")})


def branch_union(spark, folder):
    """How many pairs came through each branch."""
    branch = F.when(F.col("pass_1_is_duplicate").isNull(), F.lit("gate")).when(
        F.col("second_check_ran"), F.lit("verified")).otherwise(F.lit("first"))
    outcome = C.cascade(scored(spark, folder), first_scorer, second_scorer)
    return outcome.groupBy(branch.alias("branch")).agg(F.count(F.lit(1)).alias("pairs"))


def review_rows(spark, folder):
    first = C.pandas_classifier(_flaky_first(), C.FIRST_RESULT, on_error="review")
    outcome = C.cascade(scored(spark, folder), first, second_scorer, on_error="review")
    return outcome.filter("error IS NOT NULL").select(*KEY, "is_duplicate", "confidence", "needs_review",
                                                      "duplicate_type", "verifier_final_route", "error")


def label_to_int(spark, folder):
    labels = progress(spark, folder).withColumn("flag", F.col("is_duplicate").try_cast("boolean"))
    return labels.select(*KEY, C.label_to_int(F.col("flag")).alias("is_duplicate"), "final_confidence")


def label_checkpoints(spark, folder):
    """Labels arrive in batches; a second run finds nothing left to do."""
    source = S.write_pairs(scored(spark, folder), work_path(spark, "scored"))
    store = work_path(spark, "labels")
    for _ in range(2):
        labelling.label_in_batches(spark.read.parquet(source), store, first_scorer, second_scorer, batches=4)
    return spark.read.parquet(store).select(*KEY, "is_duplicate", "final_confidence")


def label_pairs_job(spark, folder):
    """Load, merge earlier labels, classify the rest, write; all rows of the final table."""
    source = S.write_pairs(scored(spark, folder), work_path(spark, "scored"))
    earlier = S.write_pairs(progress(spark, folder), work_path(spark, "progress"))
    report = labelling.label_pairs_job(
        spark, source, work_path(spark, "labels"), work_path(spark, "out"), work_path(spark, "out-2"),
        first_scorer, second_scorer, earlier_path=earlier, batches=2)
    back = SP.csv_reader(spark).csv(report.output_path)
    return back.select("repo", *[F.col(c).cast("bigint").alias(c) for c in KEY[1:]],
                       F.col("is_duplicate").cast("int").alias("is_duplicate"),
                       F.col("final_confidence").cast("double").alias("final_confidence"),
                       F.lit(report.processed).cast("bigint").alias("processed"),
                       F.lit(report.skipped).cast("bigint").alias("skipped"))


def fail_fast(spark, folder):
    """The run stops at the failing batch; labels of the batches before it are kept."""
    source = S.write_pairs(scored(spark, folder), work_path(spark, "scored"))
    store = work_path(spark, "labels")
    worst = F.max(labelling.batch_of(4))
    last = spark.read.parquet(source).agg(worst.alias("b")).first()["b"]

    def breaks(pairs):
        failing = F.when(labelling.batch_of(4) == last, F.raise_error("no answer").cast("boolean"))
        return first_scorer(pairs).withColumn("is_duplicate", F.coalesce(failing, F.col("is_duplicate")))

    stopped = False
    try:
        labelling.label_in_batches(spark.read.parquet(source), store, breaks, second_scorer, batches=4)
    except labelling.ClassificationStopped:
        stopped = True
    kept = spark.read.parquet(store).groupBy(labelling.batch_of(4).cast("bigint").alias("batch"))
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.sum("is_duplicate").cast("bigint").alias("duplicates"), F.lit(stopped).alias("stopped"))


QUERIES = {f.__name__: f for f in (
    scan_issues, issues_per_repo_cap, scan_multi_repo, scan_pairs_csv, scan_progress, repo_pairs, block_pairs, block_counts, unique_issues,
    issue_table, pair_embeddings, missing_vectors, pair_cosine, scored_pair_corpus, merge_progress, resume_antijoin, already_labelled,
    counts, coerce_pair_types, write_pairs, write_scored_pairs, write_labelled_pairs, write_with_fallback, llm_gate,
    second_check_needed, classify_pairs, classify_texts, cascade, text_cascade, branch_union, review_rows, label_to_int, label_checkpoints,
    label_pairs_job, fail_fast)}

_K = "repo, issue_1_number, issue_2_number"
_HASHED = """
    toks as (select repo, issue_number, unnest(regexp_extract_all(lower(issue_text), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+')) as tok from issue_table),
    parts as (select repo, issue_number, cast(('0x' || substring(md5(tok), 1, 8)) as bigint) % 256 as at,
                     sum(case when substring(md5(tok), 9, 1) < '8' then 1 else -1 end) as x from toks group by all),
    lens as (select repo, issue_number, sqrt(sum(x * x)) as len from parts group by all),
    units as (select p.repo, p.issue_number, p.at, cast(cast(p.x / case when l.len > 0 then l.len else 1 end as float) as double) as x
              from parts p join lens l on p.repo = l.repo and p.issue_number = l.issue_number)"""
_ISSUE_TABLE = f"""issue_table as (
    select distinct repo, issue_number, {normalize_sql('issue_text')} as issue_text, repo || '#' || issue_number as issue_key
    from (select repo, issue_1_number as issue_number, issue_1_text as issue_text from pairs
          union all select repo, issue_2_number, issue_2_text from pairs))"""
_FIRST = """judged as (select *, cosine_similarity >= 0.6 as dup1, ((issue_1_number * 31 + issue_2_number * 17) % 100) / cast(100 as double) as conf1,
    (issue_1_number + issue_2_number) % 11 = 0 as rev1, cosine_similarity >= 0.55 as dup2,
    ((issue_1_number * 13 + issue_2_number * 7) % 100) / cast(100 as double) as conf2 from scored_pairs),
    gated as (select *, cosine_similarity >= 0.40 as asked,
              rev1 or conf1 < case when dup1 then cast(0.9 as double) else cast(0.85 as double) end as again from judged)"""
_WORDS = "regexp_extract_all(lower({}), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+')"
_TEXT_SETS = f"""w as (select *, {_WORDS.format('issue_1_text')} as w1, {_WORDS.format('issue_2_text')} as w2 from pairs),
    s as (select * exclude (w1, w2), list_distinct(w1) as w1, list_distinct(w2) as w2,
                 list_distinct(list_transform(range(1, greatest(len(w1) - 1, 1) + 1), lambda i: array_to_string(list_slice(w1, i, i + 1), ' '))) as s1,
                 list_distinct(list_transform(range(1, greatest(len(w2) - 1, 1) + 1), lambda i: array_to_string(list_slice(w2, i, i + 1), ' '))) as s2 from w),
    i as (select *, len(list_intersect(s1, s2)) as sc, len(s1) + len(s2) - len(list_intersect(s1, s2)) as sa,
                 len(list_intersect(w1, w2)) as wc, least(len(w1), len(w2)) as wa from s),
    judged as (select *, cast(sc as double) / sa as j, cast(wc as double) / wa as c, contains(issue_1_text, '?') and contains(issue_2_text, '?') as asking from i),
    passes as (select *, j >= 0.3 as dup1, 0.5::double + 0.5::double * case when j >= 0.3 then (j - 0.3::double) / 0.7::double else (0.3::double - j) / 0.3::double end as conf1,
                      c >= 0.6 as dup2, 0.5::double + 0.5::double * case when c >= 0.6 then (c - 0.6::double) / 0.4::double else (0.6::double - c) / 0.6::double end as conf2 from judged),
    told as (select *, conf1 < 0.6 as rev1, cosine_similarity >= 0.5 as asked, conf1 < 0.6 or conf1 < case when dup1 then 0.9 else 0.85 end as again from passes)"""
_BAD = "(issue_1_number + issue_2_number) % 97 = 0"
_LABEL = "case when not asked then 0 when again then dup2::int else dup1::int end"
_CONF = "case when not asked then cast(1 as double) when again then conf2 else conf1 end"
_SUM = "(issue_1_number + issue_2_number)"
_TEXTS = "md5(issue_1_text || '|' || issue_2_text)"

SQL = {
    "scan_issues": with_views("issues", "select repo_name, issue_number, title, body from issues"),
    "issues_per_repo_cap": with_views("issues", """select repo_name, issue_number, pos from (
        select *, row_number() over (partition by repo_name order by issue_number desc) as pos from issues) where pos <= 7"""),
    "scan_multi_repo": with_views("issues", """
        select repo_name, count(*) as issues, 'read' as kind from issues group by repo_name
        union all select '', count(*), 'broken' from issues where repo_name = 'src1'
        union all select 'part=absent', 0, 'FileNotFoundException' union all select 'part.json.gz', 0, 'truncated'"""),
    "scan_pairs_csv": with_views("pairs", f"select {_K}, {_TEXTS} as texts, '' as is_duplicate from pairs"),
    "scan_progress": with_views("progress", f"select {_K}, is_duplicate, final_confidence from progress"),
    "repo_pairs": with_views("issues", """+capped as (
        select * from issues qualify row_number() over (partition by repo_name order by issue_number desc) <= 30)
        select a.repo_name as repo, a.issue_number as issue_1_number, b.issue_number as issue_2_number, '' as is_duplicate
        from capped a join capped b on a.repo_name = b.repo_name and a.issue_number > b.issue_number"""),
    "block_pairs": with_views("block_pairs", f"select {_K}, '' as is_duplicate from block_pairs"),
    "block_counts": with_views("block_pairs", """
        select i.repo_name, i.issues, count(p.repo) as pairs
        from (select repo_name, count(*) as issues from issues group by 1) i left join block_pairs p on p.repo = i.repo_name group by all"""),
    "unique_issues": with_views("pairs", """+s as (
        select repo, issue_1_number as issue_number, 1 as side, issue_1_number as a, issue_2_number as b,
               issue_1_number || '/' || issue_2_number as issue_text from pairs
        union all select repo, issue_2_number, 2, issue_1_number, issue_2_number, issue_2_number || '\\' || issue_1_number from pairs)
        select repo, issue_number, issue_text from s
        qualify row_number() over (partition by repo, issue_number order by side, a desc, b desc) = 1"""),
    "issue_table": with_views("pairs", f"+{_ISSUE_TABLE} select repo, issue_number, issue_text, issue_key from issue_table"),
    "pair_embeddings": with_views("pairs", f"""+{_ISSUE_TABLE}, {_HASHED.strip()},
        told as (select i.repo, i.issue_number, round(coalesce(sum(u.x * (u.at + 1)), 0), 4) + 0.0 as weighted
                 from issue_table i left join units u on u.repo = i.repo and u.issue_number = i.issue_number
                 where i.repo <> 'src3' group by all)
        select p.repo, p.issue_1_number, p.issue_2_number, a.weighted as weighted_1, b.weighted as weighted_2
        from pairs p left join told a on a.repo = p.repo and a.issue_number = p.issue_1_number
        left join told b on b.repo = p.repo and b.issue_number = p.issue_2_number"""),
    "missing_vectors": with_views("pairs", """select repo, n as issue_number from (
        select repo, issue_1_number as n from pairs union select repo, issue_2_number from pairs) where repo = 'src3'"""),
    "pair_cosine": with_views("scored_pairs", f"""select s.repo, s.issue_1_number, s.issue_2_number,
        round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) as cosine_similarity
        from scored_pairs s join vectors a on a.issue_number = s.issue_1_number join vectors b on b.issue_number = s.issue_2_number"""),
    "scored_pair_corpus": with_views("pairs", f"select {_K}, round(cosine_similarity, 6) as cosine_similarity from pairs"),
    "merge_progress": with_views("scored_pairs", f"""
        select {_K}, case when true_label = 1 and {_SUM} % 3 < 2 then cast(1 - {_SUM} % 3 as varchar)
                          when cosine_similarity > 0.6 then 'x' end as is_duplicate,
               case when true_label = 1 and {_SUM} % 3 < 2 then ((issue_1_number * 13) % 100) / cast(100 as double) end as final_confidence
        from scored_pairs"""),
    "resume_antijoin": with_views("scored_pairs", f"select {_K} from scored_pairs where not (true_label = 1 and {_SUM} % 3 < 2)"),
    "already_labelled": with_views("progress", f"select {_K} from progress where trim(is_duplicate) <> ''"),
    "counts": with_views("pairs", """+keys as (select distinct repo_name, issue_number from issues),
        made as (select a.repo_name, count(*) as pairs from keys a join keys b on a.repo_name = b.repo_name and a.issue_number > b.issue_number group by all)
        select i.repo_name, i.issues, coalesce(m.pairs, 0) as pairs, count(p.repo) as alike
        from (select repo_name, count(*) as issues from issues group by 1) i left join made m on m.repo_name = i.repo_name
        left join pairs p on p.repo = i.repo_name group by all"""),
    "coerce_pair_types": with_views("pairs", f"""+n as (
        select {_K}, {normalize_sql('issue_1_text')} as t1, {normalize_sql('issue_2_text')} as t2 from pairs)
        select {_K}, case when (issue_1_number + issue_2_number) % 7 = 3 then 'bad' else md5(t1 || '|' || t2) end as texts,
               case when (issue_1_number + issue_2_number) % 7 = 3 then null else cast(0.5 as double) end as cosine_similarity from n"""),
    "write_pairs": with_views("pairs", f"select {_K}, length(issue_1_text) as chars_1, '' as is_duplicate from pairs"),
    "write_scored_pairs": with_views("scored_pairs", f"select {_K}, cosine_similarity from scored_pairs"),
    "write_labelled_pairs": with_views("pairs", f"""select {_K}, md5('''=' || issue_1_text) as text_1, '0.25' as final_confidence,
        'repo,issue_1_number,issue_1_text,issue_2_number,issue_2_text,cosine_similarity,is_duplicate,final_confidence' as columns from pairs"""),
    "write_with_fallback": with_views("scored_pairs", f"select {_K}, true as fell_back from scored_pairs"),
    "llm_gate": with_views("scored_pairs", f"select {_K}, cosine_similarity >= 0.40 as classify from scored_pairs"),
    "second_check_needed": with_views("scored_pairs", f"+{_FIRST} select {_K}, again from gated"),
    "classify_pairs": with_views("scored_pairs", f"""+{_FIRST}
        select {_K}, case when not {_BAD} then dup1 end as is_duplicate, case when not {_BAD} then conf1 end as confidence,
               case when not {_BAD} then rev1 end as needs_review,
               case when not {_BAD} then case when dup1 then 'same_bug' else 'not_duplicate' end end as duplicate_type,
               case when {_BAD} then 'ValueError' else '' end as error from gated"""),
    "cascade": with_views("scored_pairs", f"""+{_FIRST}
        select {_K}, case when not asked then false when again then dup2 else dup1 end as is_duplicate, {_CONF} as confidence,
               case when asked and not again then rev1 else false end as needs_review,
               case when asked and ((again and dup2) or (not again and dup1)) then 'same_bug' else 'not_duplicate' end as duplicate_type,
               case when not asked then 'cosine below 0.4: not classified'
                    when again then 'second' else 'first' end as reason,
               case when asked then dup1 end as pass_1_is_duplicate, case when asked then conf1 end as pass_1_confidence,
               case when asked then rev1 end as pass_1_needs_review, asked and again as second_check_ran,
               case when asked and again then dup1 = dup2 end as verifier_agree_with_first_pass,
               case when asked and again then 'auto_label' end as verifier_final_route from gated"""),
    "classify_texts": with_views("pairs", f"""+{_TEXT_SETS}
        select {_K}, dup1 as is_duplicate, round(conf1, 9) as confidence, rev1 as needs_review,
               case when not dup1 then 'not_duplicate' when asking then 'same_question' else 'same_bug' end as duplicate_type,
               sc || ' of ' || sa || ' shingles shared' as reason,
               array_to_string(list_slice(list_sort(list_intersect(s1, s2)), 1, 3), '|') as matching_signals,
               array_to_string(list_concat(list_slice(list_sort(list_filter(s1, lambda x: not list_contains(s2, x))), 1, 3),
                                           list_slice(list_sort(list_filter(s2, lambda x: not list_contains(s1, x))), 1, 3)), '|') as difference_signals
        from told"""),
    "text_cascade": with_views("pairs", f"""+{_TEXT_SETS}
        select {_K}, case when not asked then false when again then dup2 else dup1 end as is_duplicate,
               round(case when not asked then 1 when again then conf2 else conf1 end, 9) as confidence,
               case when asked and not again then rev1 when asked then conf2 < 0.6 else false end as needs_review,
               case when not asked or not case when again then dup2 else dup1 end then 'not_duplicate'
                    when asking then 'same_question' else 'same_bug' end as duplicate_type,
               case when not asked then 'cosine below 0.5: not classified' when again then wc || ' of ' || wa || ' words shared'
                    else sc || ' of ' || sa || ' shingles shared' end as reason,
               case when asked then dup1 end as pass_1_is_duplicate, round(case when asked then conf1 end, 9) as pass_1_confidence,
               case when asked then rev1 end as pass_1_needs_review, asked and again as second_check_ran,
               case when asked and again then dup1 = dup2 end as verifier_agree_with_first_pass,
               case when asked and again then case when conf2 < 0.6 then 'manual_review' else 'auto_label' end end as verifier_final_route from told"""),
    "branch_union": with_views("scored_pairs", f"""+{_FIRST}
        select case when not asked then 'gate' when again then 'verified' else 'first' end as branch, count(*) as pairs
        from gated group by 1"""),
    "review_rows": with_views("scored_pairs", f"""+{_FIRST}
        select {_K}, cast(null as boolean) as is_duplicate, cast(0 as double) as confidence, true as needs_review,
               'unclear' as duplicate_type, 'manual_review' as verifier_final_route, 'ValueError' as error
        from gated where asked and {_BAD}"""),
    "label_to_int": with_views("progress", f"""
        select {_K}, case when is_duplicate = '1' then 1 else 0 end as is_duplicate, final_confidence from progress"""),
    "label_checkpoints": with_views("scored_pairs", f"+{_FIRST} select {_K}, {_LABEL} as is_duplicate, {_CONF} as final_confidence from gated"),
    "label_pairs_job": with_views("progress", f"""+{_FIRST},
        m as (select g.*, p.is_duplicate as p_label, p.final_confidence as p_conf from gated g left join progress p on p.repo = g.repo
              and p.issue_1_number = g.issue_1_number and p.issue_2_number = g.issue_2_number and trim(p.is_duplicate) <> '')
        select {_K}, coalesce(cast(p_label as int), {_LABEL}) as is_duplicate,
               case when p_label is not null then p_conf else {_CONF} end as final_confidence,
               count(*) filter (where p_label is null) over () as processed,
               count(*) filter (where p_label is not null) over () as skipped from m"""),
    "fail_fast": with_views("scored_pairs", f"""+{_FIRST},
        b as (select {_LABEL} as label, cast(('0x' || substring(md5(concat_ws('|', repo, issue_1_number, issue_2_number)), 1, 8)) as bigint) % 4 as batch
              from gated)
        select batch, count(*) as kept, cast(sum(label) as bigint) as duplicates, true as stopped from b
        where batch < (select max(batch) from b) group by batch"""),
}
