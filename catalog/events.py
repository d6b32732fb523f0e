"""Webhook events in batch and stream, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import reviewers as RC
from catalog.inputs import view, with_views
from catalog.text import clean_sql
from catalog.vectors import best_sql, hashed_sql
from reposift.functions.events import hmac_sha256_hex, is_json
from reposift.operators import reviewers as R
from reposift.operators import routing
from reposift.session import work_path
from reposift.sinks import ownership_table
from reposift.sources import commits as C
from reposift.sources import events as E
from reposift.streaming import jobs

SECRET = "k3y"


def events(spark, folder):
    """One event in 20 is signed wrongly, one in 33 isn't signed."""
    bodies = view(spark, folder, "webhook_bodies")
    right = F.concat(F.lit("sha256="), hmac_sha256_hex(F.col("body"), SECRET))
    signature = F.when(F.pmod("event_id", F.lit(33)) == 0, F.lit(None)).when(
        F.pmod("event_id", F.lit(20)) == 0, F.lit("sha256=00")).otherwise(right)
    return bodies.select("event_id", "event_type", signature.alias("signature"), "body")


def messages(spark, folder):
    return C.pr_commit_messages(view(spark, folder, "commit_messages"))


def pr_commit_messages(spark, folder):
    return messages(spark, folder)


def concat_messages(spark, folder):
    """The same, for several keys at once."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select(
        "role", F.col("conv_id").alias("pr_number"), F.col("turn").alias("pos"), F.col("text").alias("message"))
    return C.pr_commit_messages(turns, ["role", "pr_number"])


def verify_signature(spark, folder):
    return routing.verify(events(spark, folder), SECRET).select("event_id", "signature_state")


def parse_event_json(spark, folder):
    parsed = routing.parse(routing.verify(events(spark, folder), SECRET))
    return parsed.select("event_id", is_json(F.col("body")).alias("json_ok"), "kind",
                         F.when(F.col("json_ok"), F.col("action")).alias("action"))


def _routed(spark, folder):
    return routing.route(routing.parse(routing.verify(events(spark, folder), SECRET)))


def payload_fields(spark, folder):
    fields = routing.payload_fields(_routed(spark, folder)).filter("repo IS NOT NULL")
    return fields.select("event_id", "installation_id", "repo", "number", "title", "raw_body")


def malformed_events(spark, folder):
    return _routed(spark, folder).filter("status >= 400").select("event_id", "status", "detail")


_RESULT = ["event_id", "kind", "route", "status", "detail", "repo", "number", "payload"]


def route_events(spark, folder):
    return routing.route_events(events(spark, folder), SECRET, messages(spark, folder)).select(*_RESULT)


def requests_to_events(spark, folder):
    """Events from raw requests, whose headers are a map."""
    raw = events(spark, folder).select("event_id", "body", F.create_map(
        F.lit("X-GitHub-Event"), F.col("event_type"), F.lit("X-Hub-Signature-256"), F.col("signature")).alias("headers"))
    return routing.verify(E.from_requests(raw), SECRET).select("event_id", "event_type", "signature_state")


def _event_files(spark, folder, rows=None, files=1, parts=1):
    """The events as JSON files, one group of ``parts`` files after the other in event order; None: a file for each task that has rows."""
    path = work_path(spark, "events")
    rows = events(spark, folder) if rows is None else rows
    last = rows.agg(F.max("event_id")).first()[0]
    for i in range(files):
        low, high = i * (last + 1) // files, (i + 1) * (last + 1) // files
        part = rows.filter(f"event_id >= {low} AND event_id < {high}")
        (part.repartition(parts) if parts else part).write.mode("append").json(path)
    return path


def stream_events(spark, folder):
    """Everything that arrives on the stream, written down unchanged."""
    stream = E.stream_events(spark, _event_files(spark, folder, parts=None))
    out = work_path(spark, "arrived")
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", work_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type", "body")


def stream_route(spark, folder):
    out = work_path(spark, "routed")
    stream = E.stream_events(spark, _event_files(spark, folder, files=2, parts=8), max_files=8)
    jobs.stream_route(stream, SECRET, out, work_path(spark, "cp"), messages(spark, folder)).awaitTermination()
    return spark.read.parquet(out).select(*_RESULT)


def stream_duplicates(spark, folder):
    """Each new issue is compared with the issues before it, over three micro-batches."""
    out = work_path(spark, "verdicts")
    stream = E.stream_events(spark, _event_files(spark, folder, files=3), max_files=1)
    jobs.stream_duplicates(stream, SECRET, work_path(spark, "vectors"), out, work_path(spark, "cp"), 256).awaitTermination()
    found = spark.read.parquet(f"{out}/verdicts")
    return found.select("repo_name", "issue_number", "is_duplicate", F.round("similarity_score", 6).alias("similarity_score"),
                        "duplicate_of_number")


def stream_reviewers(spark, folder):
    owners = R.file_ownership(view(spark, folder, "commits"), RC.AS_OF)
    path, out = work_path(spark, "prs"), work_path(spark, "reviewers")
    C.prs_from_files(view(spark, folder, "pr_files")).write.parquet(path)
    stream = spark.readStream.schema(C.PR_SCHEMA).parquet(path)
    jobs.stream_reviewers(stream, owners, R.dir_ownership(owners), out, work_path(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def stream_reviewers_stored(spark, folder):
    """Pull requests as a stream against a stored table that was filled by two writers."""
    owners = R.file_ownership(view(spark, folder, "commits"), RC.AS_OF)
    table, path, out = work_path(spark, "ownership"), work_path(spark, "prs"), work_path(spark, "reviewers")
    first = F.pmod(F.xxhash64("file", "author"), F.lit(2)) == 0
    for writer, part in (("one", owners.filter(first)), ("two", owners.filter(~first))):
        ownership_table.append(part, table, writer)
    C.prs_from_files(view(spark, folder, "pr_files")).write.parquet(path)
    stream = spark.readStream.schema(C.PR_SCHEMA).parquet(path)
    jobs.stream_reviewers_stored(stream, table, out, work_path(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def stream_ingest_history(spark, folder):
    """History in three increments adds up to the history at once."""
    path, out = work_path(spark, "commits"), work_path(spark, "owners")
    schema = T.StructType([T.StructField("repo_name", T.StringType()), T.StructField("file", T.StringType()),
                           T.StructField("author", T.StringType()), T.StructField("weight", T.DoubleType()),
                           T.StructField("date", T.TimestampNTZType())])
    view(spark, folder, "commits").select(*schema.names).repartition(3, "author").write.parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.stream_ingest_history(stream, RC.AS_OF, out, work_path(spark, "cp")).awaitTermination()
    return jobs.ingested_ownership(spark, out).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (
    pr_commit_messages, concat_messages, verify_signature, parse_event_json, payload_fields, malformed_events,
    route_events, requests_to_events, stream_events, stream_route, stream_duplicates, stream_reviewers,
    stream_reviewers_stored, stream_ingest_history)}

_IPAD = bytes(b ^ 0x36 for b in SECRET.encode().ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in SECRET.encode().ljust(64, b"\0")).hex()
_HMAC = f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(body))))"
_EVENTS = f"""+events_in as (
    select event_id, event_type as kind, body, case when event_id % 33 = 0 then null when event_id % 20 = 0 then 'sha256=00'
           else 'sha256=' || {_HMAC} end as signature from webhook_bodies),
    st as (select *, case when signature is null then 'missing' when signature <> 'sha256=' || {_HMAC} then 'invalid' else 'valid' end as state,
           json_valid(body) as json_ok from events_in),
    pj as (select *, case when json_ok then body end as js, case when kind = 'pull_request' then 'pull_request' else 'issue' end as item from st),
    pk as (select *, json_extract_string(js, '$.action') as action, json_extract(js, '$.' || item) as it from pj),
    rt as (select *, case when state <> 'valid' or not json_ok then 'refused' when kind = 'ping' then 'ping'
             when kind not in ('issues', 'pull_request') then 'ignored'
             when not (kind = 'issues' and action in ('opened', 'reopened') or kind = 'pull_request' and action in ('opened', 'reopened', 'synchronize')) then 'ignored'
             when json_extract(js, '$.installation') is null then 'malformed:installation'
             when not list_contains(json_keys(it), 'body') then 'malformed:body' else kind end as r from pk),
    f as (select *, split_part(r, ':', 1) as route, coalesce(json_extract_string(it, '$.body'), '') as raw_body,
             cast(json_extract_string(it, '$.number') as bigint) as num, json_extract_string(it, '$.title') as ttl,
             json_extract_string(js, '$.repository.full_name') as rp,
             case when state <> 'valid' then 401 when not json_ok or r like 'malformed%' then 400 else 200 end as status,
             case when state = 'missing' then 'Unauthorized: Missing signature header' when state = 'invalid' then 'Unauthorized: Invalid signature'
                  when not json_ok then 'Bad Request: Invalid JSON payload' when r = 'ping' then 'Webhook received successfully!'
                  when r like 'malformed%' then 'Malformed payload: missing key ''' || split_part(r, ':', 2) || ''''
                  when r = 'ignored' and kind = 'issues' then 'Ignored issue action: ' || action
                  when r = 'ignored' and kind = 'pull_request' then 'Ignored PR action: ' || action
                  when r = 'ignored' then 'Ignored event type: ' || kind
                  else 'Processed ' || case when kind = 'issues' then 'Issue' else 'PR' end || ' #' || json_extract_string(it, '$.number') || ' (' || action || ')' end as detail
          from rt)"""
_JOINED = "jm as (select pr_number, string_agg(message, ' ' order by pos) as messages from commit_messages group by 1)"
_DONE = "route in ('issues', 'pull_request')"
_ROUTED = _EVENTS + ", " + _JOINED + f"""
    select event_id, kind, route, status, detail, case when {_DONE} then rp end as repo, case when {_DONE} then num end as number,
           case when route = 'issues' then 'TITLE: ' || {clean_sql('ttl')} || ' | BODY: ' || {clean_sql('raw_body')}
                when route = 'pull_request' then 'TITLE: ' || ttl || ' | COMMITS: ' || {clean_sql('messages')} || ' | DESCRIPTION: ' || {clean_sql('raw_body')} end as payload
    from f left join jm on jm.pr_number = f.num and f.route = 'pull_request'"""

SQL = {
    "pr_commit_messages": with_views("commit_messages", "select pr_number, string_agg(message, ' ' order by pos) as messages from commit_messages group by 1"),
    "concat_messages": "select role, conv_id as pr_number, string_agg(text, ' ' order by turn) as messages from conversations group by 1, 2",
    "verify_signature": with_views("webhook_bodies", _EVENTS + " select event_id, state as signature_state from f"),
    "requests_to_events": with_views("webhook_bodies", _EVENTS + " select event_id, kind as event_type, state as signature_state from f"),
    "parse_event_json": with_views("webhook_bodies", _EVENTS + " select event_id, json_ok, kind, action from f"),
    "payload_fields": with_views("webhook_bodies", _EVENTS + f"""
        select event_id, cast(json_extract_string(js, '$.installation.id') as bigint) as installation_id, rp as repo, num as number,
               ttl as title, raw_body from f where {_DONE}"""),
    "malformed_events": with_views("webhook_bodies", _EVENTS + " select event_id, status, detail from f where status >= 400"),
    "route_events": with_views("webhook_bodies commit_messages", _ROUTED),
    "stream_events": with_views("webhook_bodies", "select event_id, event_type, body from webhook_bodies"),
    "stream_route": with_views("webhook_bodies commit_messages", _ROUTED),
    "stream_duplicates": with_views("webhook_bodies", _EVENTS + f""",
        t as (select rp as repo_name, num as issue_number, 'TITLE: ' || {clean_sql('ttl')} || ' | BODY: ' || {clean_sql('raw_body')} as text
              from f where route = 'issues'),""" + hashed_sql("t", "repo_name, issue_number", "text") + ","
                                    + best_sql("t", "q.issue_number > v.issue_number") + """
        select repo_name, issue_number, is_duplicate, round(similarity_score, 6) as similarity_score, duplicate_of_number from verdicts"""),
    "stream_reviewers": RC.SQL["recommend_reviewers"],
    "stream_reviewers_stored": RC.SQL["recommend_reviewers"],
    "stream_ingest_history": RC.SQL["file_ownership"],
}
