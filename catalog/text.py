"""Text steps, text shapes and scalar helpers over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import WS, view, with_views
from reposift.functions import prompts
from reposift.functions import text as X
from reposift.functions import vectors as V


def _over_markdown(step):
    def query(spark, folder):
        return view(spark, folder, "markdown").select("id", step(F.col("raw")).alias("text"))

    return query


STEPS = {
    "strip_html_comments": X.strip_html_comments,
    "strip_code_blocks": X.strip_code_blocks,
    "strip_inline_code": X.strip_inline_code,
    "strip_urls": X.strip_urls,
    "unwrap_links": X.unwrap_links,
    "strip_headings": X.strip_headings,
    "strip_blockquotes": X.strip_blockquotes,
    "strip_bold": X.strip_bold,
    "strip_italics": X.strip_italics,
    "collapse_whitespace": X.collapse_whitespace,
    "clean_text": X.clean_text,
    "normalize_text": X.normalize_text,
    "clip_issue_text": X.clip_issue_text,
}


def or_empty(spark, folder):
    """Bodies with the empty ones turned into null and back."""
    body = F.when(F.col("issue_number") > 0, F.nullif(F.col("repo_name"), F.lit("src0")))
    return view(spark, folder, "issues").select("issue_number", X.or_empty(body).alias("text"))


def clean_text_links_first(spark, folder):
    return view(spark, folder, "markdown").select("id", X.clean_text(F.col("raw"), links_first=True).alias("text"))


def _over_issues(make):
    def query(spark, folder):
        return view(spark, folder, "issues").select(
            "repo_name", "issue_number", make(F.col("title"), F.col("body")).alias("text"))

    return query


def pr_payload(spark, folder):
    payload = X.pr_payload(F.col("title"), F.col("title"), F.col("body"))
    return view(spark, folder, "issues").select("repo_name", "issue_number", payload.alias("text"))


def issue_key(spark, folder):
    return view(spark, folder, "issues").select(X.issue_key(F.col("repo_name"), F.col("issue_number")).alias("id"))


def fence_text(spark, folder):
    return view(spark, folder, "issues").select(
        "issue_number", X.fence_text(F.col("issue_number"), F.col("body")).alias("text"))


def escape_csv_formula(spark, folder):
    """Cells of all kinds: every message behind each of a few leading characters."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", " =", "", "'")]),
                        (F.pmod(F.col("pos"), F.lit(7)) + 1).cast("int"))
    cells = view(spark, folder, "commit_messages").withColumn("cell", F.concat(lead, "message"))
    return cells.select("pr_number", "pos", X.escape_csv_formula(F.col("cell")).alias("cell"))


def render_prompts(spark, folder):
    """Requests of both passes for each issue against itself; whole texts, compared by digest."""
    issues = view(spark, folder, "issues").withColumn("text", X.normalize_text(F.col("body")))
    pair = (F.col("repo_name"), F.lit(0.5), F.col("issue_number"), F.col("text"), F.col("issue_number") + 1, F.col("text"))
    first = F.struct(F.lit(True).alias("is_duplicate"), F.lit(0.5).alias("confidence"),
                     F.array(F.col("repo_name")).alias("matching_signals"))
    one, two = prompts.first_pass_prompt(*pair), prompts.verify_prompt(*pair, first)
    return issues.select("issue_number", F.md5(one).alias("first_md5"), F.length(one).cast("bigint").alias("first_chars"),
                         F.md5(two).alias("verify_md5"), F.length(two).cast("bigint").alias("verify_chars"))


def l2_normalize(spark, folder):
    raw = view(spark, folder, "vectors").withColumn(
        "v", F.transform("embedding", lambda x: F.when(F.col("label") > 0, x.cast("double") * F.col("label")).otherwise(0.0)))
    unit = raw.withColumn("unit", V.l2_normalize(F.col("v")))
    return unit.select("issue_number", F.posexplode("unit").alias("pos", "x")).select(
        "issue_number", F.col("pos").cast("bigint").alias("pos"), F.round("x", 9).alias("x"))


def f1(spark, folder):
    labels = spark.read.parquet(f"{folder}/lineitem.parquet")
    return labels.select("l_orderkey", "l_linenumber", F.round(V.f1(F.col("l_discount"), F.col("l_tax"), 1e-10), 9).alias("f1"))


def clip(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", V.clip(F.col("l_quantity") / 40.0, 0.5, 1.0).alias("x"))


def distance_to_similarity(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", F.round(
        V.distance_to_similarity(F.col("l_quantity") / 25.0), 9).alias("similarity"))


QUERIES = {
    **{name: _over_markdown(step) for name, step in STEPS.items()},
    "embedding_text": _over_issues(X.embedding_text),
    "combine_text": _over_issues(X.combine_text),
    "issue_payload": _over_issues(X.issue_payload),
    **{f.__name__: f for f in (or_empty, clean_text_links_first, pr_payload, issue_key, fence_text, escape_csv_formula,
                               render_prompts, l2_normalize, f1, clip, distance_to_similarity)},
}

# Fixed patterns: the same steps for RE2, without back-references, \s spelled out.
_STEP_SQL = {
    "strip_html_comments": ("(?s)<!--.*?-->", ""),
    "strip_code_blocks": ("(?s)```.*?```", ""),
    "strip_inline_code": ("`[^`]*`", ""),
    "strip_urls": (r"https?://[a-z!$-_]+", ""),
    "unwrap_links": (r"\[([^\]]+)\]\([^\)]+\)", r"\1"),
    "strip_headings": (f"(?m)^#+[{WS}]+", ""),
    "strip_blockquotes": (f"(?m)^>[{WS}]+", ""),
    "strip_bold": (r"\*\*(.*?)\*\*|__(.*?)__", r"\1\2"),
    "strip_italics": (r"\*(.*?)\*|_(.*?)_", r"\1\2"),
}


def replace_all(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def step_sql(name: str, text: str) -> str:
    if name == "collapse_whitespace":
        return f"trim({replace_all(text, f'[{WS}]+', ' ')}, ' ')"
    return replace_all(text, *_STEP_SQL[name])


def clean_sql(text: str, links_first: bool = False) -> str:
    out = f"coalesce({text}, '')"
    order = list(_STEP_SQL) + ["collapse_whitespace"]
    if links_first:
        order[3], order[4] = order[4], order[3]
    for name in order:
        out = step_sql(name, out)
    return out


def trim_sql(text: str) -> str:
    return replace_all(text, f"^[{WS}]+|[{WS}]+$", "")


_BLANK = WS.replace(r"\n", "")


def normalize_sql(text: str) -> str:
    out = f"replace(replace(coalesce({text}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    out = replace_all(trim_sql(out), r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", r"\n").replace(r"'\n'", "chr(10)")
    return replace_all(out, rf"[{_BLANK}]+\n", r"\n").replace(r"'\n'", "chr(10)")


def clip_sql(text: str) -> str:
    note = "[TRUNCATED: issue text exceeded the maximum length for classification.]"
    return (f"case when length({text}) > 12000 then substring({text}, 1, 12000) || chr(10) || chr(10) || '{note}' "
            f"else {text} end")


_ISSUE_TEXT = "select repo_name, issue_number, {} as text from issues"


def _prompt_sql(template: str, extra: str = "") -> str:
    fence = "'BEGIN_UNTRUSTED_ISSUE_' || {n} || chr(10) || t || chr(10) || 'END_UNTRUSTED_ISSUE_' || {n}"
    values = ["repo_name", "'0.5'", fence.format(n="issue_number"), fence.format(n="(issue_number + 1)"), extra]
    pieces = template.replace("'", "''").replace("\n", "' || chr(10) || '").split("%s")
    out = f"'{pieces[0]}'"
    for value, piece in zip(values, pieces[1:]):
        out += f" || {value} || '{piece}'"
    return out


_FIRST_JSON = """'{"is_duplicate":true,"confidence":0.5,"matching_signals":["' || repo_name || '"]}'"""

SQL = {
    **{name: with_views("markdown", f"select id, {step_sql(name, 'raw')} as text from markdown")
       for name in (*_STEP_SQL, "collapse_whitespace")},
    "clean_text": with_views("markdown", f"select id, {clean_sql('raw')} as text from markdown"),
    "clean_text_links_first": with_views("markdown", f"select id, {clean_sql('raw', True)} as text from markdown"),
    "normalize_text": with_views("markdown", f"select id, {normalize_sql('raw')} as text from markdown"),
    "clip_issue_text": with_views(
        "markdown", f"+n as (select id, {normalize_sql('raw')} as t from markdown) select id, {clip_sql('t')} as text from n"),
    "or_empty": with_views("issues", "select issue_number, coalesce(nullif(repo_name, 'src0'), '') as text from issues"),
    "embedding_text": with_views("issues", _ISSUE_TEXT.format(
        f"{trim_sql('title')} || chr(10) || {trim_sql("coalesce(body, '')")}")),
    "combine_text": with_views("issues", _ISSUE_TEXT.format(f"title || chr(10) || {trim_sql("coalesce(body, '')")}")),
    "issue_payload": with_views("issues", _ISSUE_TEXT.format(
        f"'TITLE: ' || {clean_sql('title')} || ' | BODY: ' || {clean_sql('body')}")),
    "pr_payload": with_views("issues", _ISSUE_TEXT.format(
        f"'TITLE: ' || title || ' | COMMITS: ' || {clean_sql('title')} || ' | DESCRIPTION: ' || {clean_sql('body')}")),
    "issue_key": with_views("issues", "select repo_name || '#' || issue_number as id from issues"),
    "fence_text": with_views("issues", """
        select issue_number, 'BEGIN_UNTRUSTED_ISSUE_' || issue_number || chr(10) || body || chr(10)
               || 'END_UNTRUSTED_ISSUE_' || issue_number as text from issues"""),
    "escape_csv_formula": with_views("commit_messages", """+cells as (
        select pr_number, pos, ['=', '+', '-', '@', ' =', '', ''''][(pos % 7) + 1] || message as cell from commit_messages)
        select pr_number, pos, case when cell[1] in ('=', '+', '-', '@') then '''' || cell else cell end as cell from cells"""),
    "render_prompts": with_views("issues", f"""+n as (select repo_name, issue_number, {normalize_sql('body')} as t from issues),
        p as (select issue_number, {_prompt_sql(prompts.FIRST_PASS_TEMPLATE)} as one,
                     {_prompt_sql(prompts.VERIFY_TEMPLATE, _FIRST_JSON)} as two from n)
        select issue_number, md5(one) as first_md5, length(one) as first_chars, md5(two) as verify_md5,
               length(two) as verify_chars from p"""),
    "l2_normalize": with_views("vectors", """+n as (
        select issue_number, list_transform(cast(embedding as double[]), lambda x: case when label > 0 then x * label else cast(0 as double) end) as v from vectors),
        m as (select issue_number, v, sqrt(list_dot_product(v, v)) as len from n)
        select issue_number, unnest(range(0, len(v))) as pos,
               round(unnest(v) / case when len > 0 then len else 1.0 end, 9) as x from m"""),
    "f1": "select l_orderkey, l_linenumber, round(2.0 * (l_discount * l_tax) / (l_discount + l_tax + cast(1e-10 as double)), 9) as f1 from lineitem",
    "clip": "select l_orderkey, l_linenumber, greatest(cast(0.5 as double), least(cast(1 as double), l_quantity / 40)) as x from lineitem",
    "distance_to_similarity": """select l_orderkey, l_linenumber, round(greatest(cast(0 as double),
        least(cast(1 as double), 1 - l_quantity / 25)), 9) as similarity from lineitem""",
}
