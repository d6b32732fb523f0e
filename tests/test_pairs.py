import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from reposift.operators import pairs as P
from reposift.sinks import pair_tables as S
from reposift.sources import issues as I
from reposift.sources import pairs as SP

KEY = SP.PAIR_KEY


def issues(spark, counts):
    rows = [(repo, n + 1, f" t{n}", f"b{n}\n " if n % 2 else None) for repo, size in counts.items() for n in range(size)]
    return spark.createDataFrame(rows, "repo_name string, issue_number long, title string, body string")


def test_pair_counts(spark):
    table = issues(spark, {"a": 30, "b": 60, "c": 100, "d": 1})
    made = {r.repo: r["count"] for r in P.repo_pairs(table, 100).groupBy("repo").count().collect()}
    assert made == {"a": 435, "b": 1770, "c": 4950}
    assert {r.repo_name: r.pairs for r in P.pair_counts(table, 1000).collect()} == {**made, "d": 0}
    capped = {r.repo: r["count"] for r in P.repo_pairs(table, 50).groupBy("repo").count().collect()}
    assert capped == {"a": 435, "b": 1225, "c": 1225}


def test_no_issue_is_left_out(spark, work):
    table = issues(spark, {"a": 120, "b": 120})
    pairs = P.block_pairs(table, 25)
    wanted = {(repo, i, j) for repo in "ab" for i in range(1, 121) for j in range(1, i) if i // 25 == j // 25}
    assert {(r.repo, r.issue_1_number, r.issue_2_number) for r in pairs.collect()} == wanted
    assert P.issue_table(pairs).count() == 240
    assert sum(r.pairs for r in P.pair_counts(table, 25).collect()) == len(wanted)
    assert spark.read.parquet(S.write_pairs(pairs, work())).count() == len(wanted)
    typed, bad = P.coerce_pair_types(pairs.selectExpr("*", "0.5 as cosine_similarity"))
    assert (typed.count(), bad.count()) == (len(wanted), 0)
    with pytest.raises(ValueError):
        P.block_pairs(table, 0)


def test_pairs_are_newest_first(spark):
    rows = P.repo_pairs(issues(spark, {"a": 4}), 3).collect()
    assert {(r.issue_1_number, r.issue_2_number) for r in rows} == {(4, 3), (4, 2), (3, 2)}
    assert {r.issue_1_text for r in rows if r.issue_1_number == 4} == {" t3\nb3"} and rows[0].is_duplicate == ""


def test_first_text_of_an_issue_wins(spark):
    pairs = spark.createDataFrame([("r", 3, "x", 2, "second side"), ("r", 2, "old", 1, "y"), ("r", 2, "older", 0, "z")],
                                  "repo string, issue_1_number long, issue_1_text string, issue_2_number long, issue_2_text string")
    assert {r.issue_number: r.issue_text for r in P.issue_table(pairs).collect()} == {3: "x", 2: "old", 1: "y", 0: "z"}


def test_missing_vector(spark):
    pairs = spark.createDataFrame([("r", 1, 2), ("r", 1, 3)], "repo string, issue_1_number long, issue_2_number long")
    vectors = spark.createDataFrame([("r", 1, [1.0, 0.0]), ("r", 2, [-0.6, 0.8])], "repo string, issue_number long, embedding array<float>")
    assert [(r.repo, r.issue_number) for r in P.missing_vectors(P.pair_embeddings(pairs, vectors)).collect()] == [("r", 3)]
    kept = P.score_pairs(pairs, vectors, strict=False).collect()
    assert [(r.issue_2_number, round(r.cosine_similarity, 6)) for r in kept] == [(2, -0.6)]
    with pytest.raises((PySparkException, Py4JJavaError)):
        P.score_pairs(pairs, vectors).collect()


def test_progress_merge(spark):
    table = spark.createDataFrame([("r", 1, 2, "0"), ("r", 1, 3, None), ("r", 1, 4, " ")], "repo string, issue_1_number long, issue_2_number long, is_duplicate string")
    earlier = spark.createDataFrame(
        [("r", 1, 2, "1", 0.3, 1), ("r", 1, 2, "0", 0.9, 2), ("r", 1, 2, "1", 0.2, 3), ("r", 1, 3, "  ", 0.5, 1), ("r", 9, 9, "1", 0.1, 1)],
        "repo string, issue_1_number long, issue_2_number long, is_duplicate string, final_confidence double, at int")
    merged = {r.issue_2_number: (r.is_duplicate, r.final_confidence) for r in P.merge_progress(table, earlier, "at").collect()}
    assert merged == {2: ("1", 0.2), 3: (None, None), 4: (" ", None)}
    assert {r.issue_2_number for r in P.unlabelled(table).collect()} == {3, 4}
    assert {r.issue_2_number for r in P.unlabelled(table, earlier.filter("issue_2_number <> 2")).collect()} == {3, 4}


def test_csv_round_trip(spark, work):
    texts = ['plain', 'two\nlines', 'say "hi", ok', '=1+1', ' lead and trail ', 'back\\slash "q"', 'crlf\r\nend']
    df = spark.createDataFrame([("r", i, t, i + 1, t, "") for i, t in enumerate(texts)], SP.PAIR_SCHEMA)
    back = SP.read_pairs_csv(spark, S.write_pairs(df, work(), "csv"))
    assert {r.issue_1_number: r.issue_1_text for r in back.collect()} == dict(enumerate(texts))


def test_labelled_columns(spark, work):
    df = spark.createDataFrame([("r", 1, "=x", 2, "y", 0.5, 1, "secret")],
                               "repo string, issue_1_number long, issue_1_text string, issue_2_number long, issue_2_text string, final_confidence double, is_duplicate int, note string")
    back = SP.csv_reader(spark).csv(S.write_labelled_pairs(df, work()))
    assert back.columns == ["repo", "issue_1_number", "issue_1_text", "issue_2_number", "issue_2_text", "is_duplicate", "final_confidence"]
    assert back.first().issue_1_text == "'=x"


def test_fallback_path(spark, work):
    df = spark.range(3)
    for denial in (PermissionError("no"), PySparkException("AccessControlException: Permission denied: user=x")):
        first, second = work(), work()

        def write(path):
            if path == first:
                raise denial
            df.write.parquet(path)

        assert S.write_with_fallback(write, first, second) == second and spark.read.parquet(second).count() == 3
        assert S.write_with_fallback(write, work(), work()) != second
    with pytest.raises(PySparkException):  # any other failure isn't hidden
        S.write_with_fallback(lambda p: df.write.parquet(p), second, work())


def test_progress_source(spark, work):
    rows = spark.createDataFrame([("r", 1, 2, "1", 0.5)], SP.PROGRESS_SCHEMA)
    first, second = work(), work()
    assert SP.read_progress(spark, first, second).count() == 0
    rows.write.parquet(second)
    assert SP.read_progress(spark, first, second).count() == 1
    rows.drop("is_duplicate").write.parquet(first)
    assert SP.read_progress(spark, first, second).count() == 0


def test_issue_dumps(spark, work):
    path, gone = work(), work()
    spark.createDataFrame([('{"repo_name":"r","number":1,"title":"t","body":null}',), ('{"number": 2',), ("",)], "value string").write.text(path)
    dumps = I.read_issue_dumps(spark, [path, gone])
    assert [(r.issue_number, r.body) for r in dumps.issues.collect()] == [(1, None)] and dumps.broken.count() == 1
    assert [tuple(r) for r in dumps.failed.collect()] == [(gone, "FileNotFoundException")]
    none = I.read_issue_dumps(spark, [gone])
    assert none.issues.count() == none.broken.count() == 0 and none.failed.count() == 1


def test_damaged_files_are_left_out_whole(spark, work):
    import gzip

    from reposift.sinks.pair_tables import put_file

    path = work("packed")
    line = b'{"repo_name": "%s", "number": 1, "title": "t"}\n'
    whole = lambda name: gzip.compress(line % name * 3000)
    bent = bytearray(whole(b"bent"))
    bent[len(bent) // 2 :] = bytes(b ^ 255 for b in bent[len(bent) // 2 :])
    files = {"a.json.gz": whole(b"a"), "two.json.gz": whole(b"two") + whole(b"two"), "cut.json.gz": whole(b"cut")[:-9], "bent.json.gz": bytes(bent),
             "none.json.gz": b"", "plain.json": line % b"plain", "sub/b.json.gz": whole(b"b")}
    for name, content in files.items():
        put_file(spark, f"{path}/{name}", content)
    dumps = I.read_issue_dumps(spark, [path])
    counts = {r["repo_name"]: r["count"] for r in dumps.issues.groupBy("repo_name").count().collect()}
    assert counts == {"a": 3000, "two": 6000, "b": 3000, "plain": 1} and dumps.broken.count() == 0
    failed = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in dumps.failed.collect()}
    assert failed["cut.json.gz"] == "truncated" and failed["bent.json.gz"] in ("damaged", "truncated") and failed.keys() == {"cut.json.gz", "bent.json.gz"}


def test_bad_types_are_set_aside(spark):
    df = spark.createDataFrame([("r", "1", "a", "2", "b", "0.5"), ("r", "x", "a", "2", "b", "0.5"), ("r", "1", "a", "2", "b", "?")],
                               "repo string, issue_1_number string, issue_1_text string, issue_2_number string, issue_2_text string, cosine_similarity string")
    typed, bad = P.coerce_pair_types(df)
    assert typed.count() == 1 and bad.count() == 2 and dict(typed.dtypes)["cosine_similarity"] == "double"
