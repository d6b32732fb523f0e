import hashlib
import hmac
import json
import os

import pytest
from pyspark.sql import functions as F

from reposift.functions.events import hmac_sha256_hex
from reposift.operators.routing import route_events
from reposift.sources.events import EVENT_SCHEMA, from_requests, stream_events
from reposift.streaming import jobs

SECRET = "s3cret"


def sign(body, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def issue(action="opened", drop=(), **fields):
    item = {"number": 7, "title": "**T**", "body": "see [d](g.md)", **fields}
    full = {"action": action, "installation": {"id": 1}, "repository": {"full_name": "o/r"}, "issue": item, "pull_request": item}
    for path in drop:
        holder = full
        *outer, last = path.split(".")
        for name in outer:
            holder = holder[name]
        holder.pop(last, None)
    return full


CASES = {
    "plain issue": ("issues", issue(), 200, "Processed Issue #7 (opened)", "TITLE: T | BODY: see d"),
    "null body": ("issues", issue(body=None), 200, "Processed Issue #7 (opened)", "TITLE: T | BODY: "),
    "closed issue": ("issues", issue("closed"), 200, "Ignored issue action: closed", None),
    "synchronised issue": ("issues", issue("synchronize"), 200, "Ignored issue action: synchronize", None),
    "pull request": ("pull_request", issue("synchronize"), 200, "Processed PR #7 (synchronize)", "TITLE: **T** | COMMITS: fix it | DESCRIPTION: see d"),
    "closed pull request": ("pull_request", issue("closed"), 200, "Ignored PR action: closed", None),
    "no action": ("issues", issue(drop=["action"]), 200, "Ignored issue action: None", None),
    "ping": ("ping", {}, 200, "Webhook received successfully!", None),
    "push": ("push", {}, 200, "Ignored event type: push", None),
    "no type": (None, {}, 200, "Ignored event type: unknown", None),
    "no installation": ("issues", issue(drop=["installation"]), 400, "Malformed payload: missing key 'installation'", None),
    "no installation id": ("issues", issue(drop=["installation.id"]), 400, "Malformed payload: missing key 'id'", None),
    "two keys missing": ("issues", issue(drop=["repository", "issue"]), 400, "Malformed payload: missing key 'repository'", None),
    "no body": ("pull_request", issue(drop=["pull_request.body"]), 400, "Malformed payload: missing key 'body'", None),
    "ignored although malformed": ("issues", issue("closed", drop=["installation"]), 200, "Ignored issue action: closed", None),
    "null repository": ("issues", {**issue(), "repository": None}, 500, "Internal Server Error: repository is not an object", None),
    "list": ("issues", [1], 500, "Internal Server Error: payload is not an object", None),
}


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(7, "fix `x` it")], "pr_number long, messages string")


def test_routes(spark, messages):
    rows = []
    for i, (kind, body, *_) in enumerate(CASES.values()):
        text = json.dumps(body, ensure_ascii=False)
        rows.append((i, kind, sign(text), text))
    got = {r.event_id: r for r in route_events(spark.createDataFrame(rows, EVENT_SCHEMA), SECRET, messages).collect()}
    for i, (name, (_, _, status, detail, payload)) in enumerate(CASES.items()):
        assert (got[i].status, got[i].detail, got[i].payload) == (status, detail, payload), name
    assert len(got) == len(CASES)


def test_refusals(spark):
    body = json.dumps(issue())
    rows = [(1, "issues", None, body), (2, "issues", "", body), (3, "issues", sign(body, "other"), body), (4, "issues", sign("{broken"), "{broken")]
    got = {r.event_id: (r.status, r.detail, r.repo) for r in route_events(spark.createDataFrame(rows, EVENT_SCHEMA), SECRET).collect()}
    missing = (401, "Unauthorized: Missing signature header", None)
    assert got == {1: missing, 2: missing, 3: (401, "Unauthorized: Invalid signature", None), 4: (400, "Bad Request: Invalid JSON payload", None)}


@pytest.mark.parametrize("secret", ["k", "é" * 20, "x" * 64, "y" * 65, "z" * 200])
def test_hmac_equals_python(spark, secret):
    for body in ("", "a", "é漢 {}", "b" * 1000):
        df = spark.createDataFrame([(body,)], "b string")
        assert "sha256=" + df.select(hmac_sha256_hex(F.col("b"), secret).alias("h")).first().h == sign(body, secret)


def test_headers(spark):
    raw = spark.createDataFrame([(1, {"X-GitHub-Event": "ping", "x-hub-signature-256": "s"}, "{}"), (2, {}, "{}")],
                                "event_id long, headers map<string,string>, body string")
    assert [(r.event_type, r.signature) for r in from_requests(raw).orderBy("event_id").collect()] == [("ping", "s"), (None, None)]


def test_stream_equals_batch(spark, work, messages):
    rows = [(i, kind, sign(json.dumps(body)), json.dumps(body)) for i, (kind, body, *_) in enumerate(CASES.values())]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    path, out, checkpoint = work(), work(), work()
    events.repartition(3).write.json(path)
    for _ in range(2):  # the second start finds nothing new
        jobs.stream_route(stream_events(spark, path, max_files=1), SECRET, out, checkpoint, messages).awaitTermination()
    columns = ["event_id", "status", "detail", "payload"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(spark.read.parquet(out)) == rows(route_events(events, SECRET, messages))


def test_stream_searches_before_it_stores(spark, work):
    path, out, table, checkpoint = (work() for _ in range(4))
    texts = {1: "login page crashes", 2: "dark mode wanted", 3: "login page crashes", 4: "dark mode wanted", 5: "something else"}
    for part in ([2, 1], [3], [5, 4, 3]):  # number 3 is opened once more
        bodies = [json.dumps(issue(number=n, title=texts[n], body="")) for n in part]
        spark.createDataFrame([(n, "issues", sign(b), b) for n, b in zip(part, bodies)], EVENT_SCHEMA).coalesce(1).write.mode("append").json(path)
    stream = stream_events(spark, path, max_files=1)
    jobs.stream_duplicates(stream, SECRET, table, out, checkpoint, 256, prefix="Bot: ").awaitTermination()
    verdicts = spark.read.parquet(f"{out}/verdicts").collect()
    got = {(r.batch, r.issue_number): r.duplicate_of_number for r in verdicts}
    assert got == {(0, 1): None, (0, 2): None, (1, 3): 1, (2, 3): 1, (2, 4): 2, (2, 5): None}
    actions = spark.read.parquet(f"{out}/actions").filter("action = 'comment'").collect()
    assert {r.message for r in actions} == {"Bot: Duplicate of #1 (100% match).", "Bot: Duplicate of #2 (100% match)."}


def test_stream_finds_what_others_stored(spark, work):
    """A preloaded table, a restart with a new checkpoint, compaction in between, and a batch that is repeated."""
    from reposift.operators.embedding import embed_texts
    from reposift.sinks import vector_table

    path, table = work(), work()
    texts = {1: "login page crashes", 2: "dark mode wanted", 7: "login page crashes", 8: "dark mode wanted", 9: "dark mode wanted"}

    def arrive(*numbers):
        bodies = [json.dumps(issue(number=n, title=texts[n], body="")) for n in numbers]
        spark.createDataFrame([(n, "issues", sign(b), b) for n, b in zip(numbers, bodies)], EVENT_SCHEMA).coalesce(1).write.mode("append").json(path)

    def run(table, checkpoint):
        out = work()
        jobs.stream_duplicates(stream_events(spark, path, max_files=1), SECRET, table, out, checkpoint, 256).awaitTermination()
        return {r.issue_number: r.duplicate_of_number for r in spark.read.parquet(f"{out}/verdicts").collect()}

    vector_table.ensure_table(spark, table)
    arrive(1, 2)
    stored = route_events(stream_source(spark, path), SECRET).filter("route = 'issues'").selectExpr(
        "repo as repo_name", "number as issue_number", "title", "payload as document")
    vector_table.upsert(embed_texts(stored, "document")[0], table, 256, version=6)
    arrive(7)
    first = work()
    assert run(table, first) == {1: None, 2: None, 7: 1}
    assert vector_table.next_version(spark, table) == 9
    arrive(8)
    assert run(table, first) == {8: 2}
    table = vector_table.compact(spark, table, work())
    assert run(table, work()) == {1: 7, 2: 8, 7: 1, 8: 2}

    # a batch that failed after storing its rows is repeated under its own name
    arrive(9)
    again = work()
    run(table, again)
    commits = f"{again}/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        os.remove(f"{commits}/{name}")
    before = {r.id: r.version for r in vector_table.current(spark, table).collect()}
    assert run(table, again) == {9: 2}
    assert {r.id: r.version for r in vector_table.current(spark, table).collect()} == before


def stream_source(spark, path):
    return spark.read.schema(EVENT_SCHEMA).json(path)


def test_stream_input_is_written_by_every_task(spark, monkeypatch):
    from pathlib import Path

    from catalog import events as CE

    rows = spark.range(400).selectExpr("id as event_id", "'ping' as event_type", "cast(null as string) as signature", "cast(id as string) as body").repartition(4)
    monkeypatch.setattr(CE, "events", lambda spark, folder: rows)
    seen, read = [], CE.E.stream_events
    monkeypatch.setattr(CE.E, "stream_events", lambda spark, path, **more: seen.append(len([*Path(path.removeprefix("file:")).glob("*.json")])) or read(spark, path, **more))
    assert sorted(r["event_id"] for r in CE.stream_events(spark, "").collect()) == list(range(400)) and seen == [4]
