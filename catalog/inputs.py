"""Engine inputs derived from the given tables.

Every view is one SELECT that reads whole tables.  Spark runs it with the
tables bound to ``{table}``, DuckDB as the CTE of the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reposift.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

_FILE = "concat(lower(p.p_type), '/', replace(p.p_brand, '#', ''), '/', replace(p.p_name, ' ', '_'), '.py')"

VIEWS = {
    # titles carry blanks at both ends
    "issues": """
        select source as repo_name, doc_id + 1 as issue_number,
               concat(' ', source, ' ', lang, ' ', cast(n_chars as string), ' ') as title, text as body
        from {documents}""",
    "vectors": """
        select concat('repo', cast(label % 3 as string)) as repo_name, vec_id + 1 as issue_number,
               concat('T', cast(vec_id as string)) as title, label, embedding, cast(1 as bigint) as version
        from {embeddings}""",
    # every line is a commit, and a changed file of the order's pull request
    "commits": f"""
        select l.l_returnflag as repo_name, {_FILE} as file, s.s_name as author, l.l_quantity as weight,
               l.l_shipdate as date, l.l_orderkey * 100 + l.l_linenumber as seq
        from {{lineitem}} l join {{part}} p on l.l_partkey = p.p_partkey join {{supplier}} s on l.l_suppkey = s.s_suppkey""",
    # line numbers 3 and 6: new file in a known directory, 5: new sub-directory, 7: root file
    "pr_files": f"""
        select l.l_returnflag as repo_name, l.l_orderkey as pr_number,
               min(s.s_name) over (partition by l.l_returnflag, l.l_orderkey) as author_username,
               cast(row_number() over (partition by l.l_returnflag, l.l_orderkey
                    order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as bigint) as pos,
               case when l.l_linenumber in (3, 6) then concat(lower(p.p_type), '/', replace(p.p_brand, '#', ''), '/new_file.py')
                    when l.l_linenumber = 5 then concat(lower(p.p_type), '/new_dir/sub/x.py')
                    when l.l_linenumber = 7 then 'NEWROOT.md'
                    else {_FILE} end as file
        from {{lineitem}} l join {{part}} p on l.l_partkey = p.p_partkey join {{supplier}} s on l.l_suppkey = s.s_suppkey""",
    # commit records as they arrive: weights and dates are text of mixed quality
    "raw_commits": f"""
        select l.l_returnflag as repo_name,
               case when l.l_discount = 0.0 then null else {_FILE} end as file,
               case when l.l_tax = 0.08 then '' else s.s_name end as author,
               case when l.l_quantity = 1 then '0' when l.l_quantity = 2 then '-3' when l.l_quantity = 3 then 'n/a'
                    when l.l_quantity = 4 then 'NaN' when l.l_quantity = 5 then null
                    else cast(cast(l.l_quantity as bigint) as string) end as weight,
               case l.l_linenumber when 1 then cast(cast(l.l_shipdate as date) as string)
                    when 2 then concat(cast(cast(l.l_shipdate as date) as string), 'T10:20:30Z')
                    when 3 then replace(cast(cast(l.l_shipdate as date) as string), '-', '')
                    when 4 then concat(cast(cast(l.l_shipdate as date) as string), 'T01:00:00+05:30')
                    when 5 then concat('on ', cast(cast(l.l_shipdate as date) as string))
                    when 6 then null
                    else concat(cast(cast(l.l_shipdate as date) as string), ' 23:59') end as date,
               cast(l.l_shipdate as date) as day, l.l_linenumber as form,
               l.l_orderkey * 100 + l.l_linenumber as seq
        from {{lineitem}} l join {{part}} p on l.l_partkey = p.p_partkey join {{supplier}} s on l.l_suppkey = s.s_suppkey""",
    "commit_messages": """
        select conv_id as pr_number, turn as pos, text as message from {conversations}""",
    "webhook_bodies": """
        select event_id, user_id,
               case event_type when 'view' then 'ping' when 'purchase' then 'pull_request' when 'signup' then 'push' else 'issues' end as event_type,
               case when event_type = 'error' then '{{"action": "opened", '
                    else concat('{{"action": "', case event_id % 4 when 0 then 'opened' when 1 then 'reopened' when 2 then 'synchronize' else 'closed' end, '"',
                                case when event_id % 50 = 1 then '' else ', "installation": {{"id": 7}}' end,
                                ', "repository": {{"full_name": "org/repo', cast(user_id % 5 as string), '"}}, "',
                                case when event_type = 'purchase' then 'pull_request' else 'issue' end,
                                '": {{"number": ', cast(event_id + 1 as string), ', "title": "T **', cast(user_id as string), '**"',
                                case when event_id % 70 = 2 then '' else concat(', "body": ',
                                     case when event_id % 9 = 0 then 'null' else '"see [docs](guide.md) and `x`"' end) end, '}}}}') end as body
        from {events}""",
    # Markdown around the whole text of every document, conversation turn and page
    "markdown": """
        select concat('d', cast(doc_id as string)) as id,
               concat('<!-- lang ', lang, chr(10), ' -->## ', source, chr(10), '> quoted **', source, '** and _', lang, '_', chr(10),
                      text, chr(10), '`n=', cast(n_chars as string), '` [doc](docs/', cast(doc_id as string), '.md) ',
                      'https://example.com/', cast(doc_id as string), '?q=1#top', chr(10), '```', chr(10), 'code_block', chr(10), '```',
                      chr(13), chr(10), '__end__ a_b_c') as raw
        from {documents}
        union all
        select concat('c', cast(conv_id as string), '-', cast(turn as string)) as id, concat('# ', role, chr(9), chr(10), '>  ', text) as raw from {conversations}
        union all
        select concat('p', cast(page_id as string)) as id, concat('[page](', url, ') ', html) as raw from {pages}""",
}

# All issues, paired with those of the same repository and block of numbers.
_BLOCK_SQL = """
    block_pairs as (select a.repo_name as repo, a.issue_number as issue_1_number, b.issue_number as issue_2_number
                    from issues a join issues b on a.repo_name = b.repo_name and a.issue_number // 200 = b.issue_number // 200
                         and a.issue_number > b.issue_number)"""

# All pairs of a repository with a TF-IDF cosine of 0.4 or more, by comparing every word of every issue.
_PAIR_SQL = """
    texts as materialized (
        select repo_name as repo, issue_number, concat(title, chr(10), regexp_replace(coalesce(body, ''), '^[WS]+|[WS]+$', '', 'g')) as issue_text from issues),
    terms as materialized (
        select repo, issue_number, word, count(*) as tf from (
            select repo, issue_number, unnest(regexp_extract_all(lower(issue_text), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+')) as word from texts)
        group by all),
    raw as (select t.repo, t.issue_number, t.word, tf * ln(((select count(*) from texts) + 1) / cast(df + 1 as double)) as w
            from terms t join (select word, count(*) as df from terms group by 1) f on f.word = t.word),
    lengths as (select repo, issue_number, sqrt(sum(w * w)) as length from raw group by all),
    comps as materialized (select r.repo, r.issue_number, word, w / length as w from raw r join lengths l on l.repo = r.repo and l.issue_number = r.issue_number where w > 0),
    alike as (select a.repo, a.issue_number as n1, b.issue_number as n2, round(sum(a.w * b.w), 9) as cosine_similarity
              from comps a join comps b on a.repo = b.repo and a.word = b.word and a.issue_number > b.issue_number group by all having cosine_similarity >= 0.4),
    pairs as materialized (
        select p.repo, n1 as issue_1_number, n2 as issue_2_number, a.issue_text as issue_1_text, b.issue_text as issue_2_text, cosine_similarity
        from alike p join texts a on a.repo = p.repo and a.issue_number = n1 join texts b on b.repo = p.repo and b.issue_number = n2)"""

# Unicode white space, spelled out because RE2 knows only the ASCII part
WS = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

EXTRA_SQL = {
    "block_pairs": ("issues", _BLOCK_SQL.strip()),
    "pairs": ("issues", _PAIR_SQL.replace("WS", WS).strip().replace("{", "{{").replace("}", "}}")),
    # every vector with its ten best matches; the shift spreads the scores over the thresholds in use
    "matches": ("vectors", """matches as materialized (
        select repo_name, query_number, match_number, same, sim, rnk from (
          select *, row_number() over (partition by repo_name, query_number order by sim desc, match_number) as rnk from (
            select q.repo_name, q.issue_number as query_number, v.issue_number as match_number, q.label = v.label as same,
                   round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 9) as sim
            from vectors q join vectors v on q.repo_name = v.repo_name and q.issue_number <> v.issue_number))
        where rnk <= 10)"""),
    "scored_pairs": ("matches", """scored_pairs as materialized (
        select repo_name as repo, query_number as issue_1_number, match_number as issue_2_number,
               case when same then 1 else 0 end as true_label,
               round(greatest(cast(0 as double), least(cast(1 as double), cast(0.15 as double) + case when same then cast(0.15 as double) else cast(0 as double) end + sim)), 9) as cosine_similarity
        from matches)"""),
    "progress": ("scored_pairs", """progress as (
        select repo, issue_1_number, issue_2_number,
               case (issue_1_number + issue_2_number) % 3 when 0 then '1' when 1 then '0' else ' ' end as is_duplicate,
               ((issue_1_number * 13) % 100) / cast(100 as double) as final_confidence
        from scored_pairs where true_label = 1)"""),
}


# tables with expensive rows; each is one file with one row group here
TEXTS = {"documents", "pages", "conversations", "events"}


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    found = {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}
    return {n: spread(df) if n in TEXTS else df for n, df in found.items()}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **tables(spark, folder, used))


def with_views(names: str, select: str) -> str:
    """DuckDB statement: the named views as CTEs in front of ``select``."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in EXTRA_SQL:
            need(EXTRA_SQL[name][0])
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    parts = []
    for name in ordered:
        if name in EXTRA_SQL:
            parts.append(EXTRA_SQL[name][1].replace("{{", "{").replace("}}", "}"))
        else:
            body = re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else m[0], VIEWS[name])
            parts.append(f"{name} as ({body.replace('{{', '{').replace('}}', '}')})")
    select = select.strip()
    glue = ", " if select.startswith("+") else " "
    return "with " + ",\n".join(parts) + glue + select.removeprefix("+")
