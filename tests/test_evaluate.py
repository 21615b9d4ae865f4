from clausemill.operators import evaluate


def test_question_scores(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    relevant = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "z"), (1, "a")], "query_id int, chunk_id string")
    hits = spark.createDataFrame([(1, "a", 1), (2, "q", 1), (2, "q", 2), (2, "a", 3), (2, "a", 4), (3, "q", 1), (4, "q", 1), (2, "b", 6)], "query_id int, chunk_id string, rank int")
    got = {r.query_id: (round(r.rr, 4), r.recall, r.precision) for r in evaluate.question_scores(asked, relevant, hits).collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.3333, 0.5, 0.25), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}


def test_published_report(spark):
    """Category means that give the published overall: MRR 15.5 / 23, recall 18 / 23, refusal 21 / 23."""
    rows = []
    for name, n, mrr, recall in (("factual", 10, 8.5, 10), ("statute", 5, 4.0, 5), ("red_flag", 4, 3.0, 3), ("out_of_scope", 4, 0.0, 0)):
        for k in range(n):
            out = name == "out_of_scope"
            rows.append(("dense", name, mrr / n, recall / n, 0.2 * recall / n, out, out and k < 2))
    scores = spark.createDataFrame(rows, "config string, category string, rr double, recall double, precision double, should_refuse boolean, refused boolean")
    row = evaluate.retrieval_report(scores).where("category = 'overall'").first()
    assert [round(x, 5) for x in (row.mrr, row.recall, row.precision, row.refusal_accuracy)] == [0.67391, 0.78261, 0.15652, 0.91304]
    empty = evaluate.retrieval_report(scores.limit(0))
    assert empty.count() == 0 and scores.limit(0).agg(evaluate.refusal_accuracy().alias("r")).first().r == 0.0


def test_regression_check(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", 1.0), ("e", 1.0)], "metric string, value double")
    now = spark.createDataFrame([("a", 0.95), ("b", 0.975), ("c", 0.5), ("d", 0.98), ("f", 1.0)], "metric string, value double")
    assert {r.metric: r.status for r in evaluate.regression_check(now, base).collect()} == {"a": "REGRESSION", "b": "WARN", "c": "OK", "d": "OK", "e": "MISSING", "f": "MISSING"}
    assert [r.metric for r in evaluate.quality_floors(spark.createDataFrame([("mrr", 0.5), ("recall", 0.9)], "metric string, value double")).collect()] == ["mrr"]


def test_verdicts(spark):
    rows = [(1, '{"faithfulness": 1, "correctness": 0.5, "relevance": 2}', False), (2, "junk", False), (3, '{"faithfulness": "1", "correctness": 1, "relevance": 1}', True)]
    df = evaluate.parse_verdicts(spark.createDataFrame(rows, "query_id int, raw string, should_refuse boolean"))
    got = {r.query_id: (r.faithfulness, r.correctness, r.relevance, r.unavailable) for r in df.collect()}
    assert got == {1: (1.0, 0.5, 0.0, False), 2: (0.0, 0.0, 0.0, True), 3: (0.0, 1.0, 1.0, False)}
    row = evaluate.answer_quality(df).first()
    assert (row.faithfulness, row.answer_quality, row.judged, row.unavailable, row.none_available) == (1.0, 0.5, 1, 1, False)
    assert evaluate.answer_quality(df.where("query_id = 2")).first().none_available


def test_audit(spark):
    rows = [(1, '{"has_pii": true, "findings": [{"category": "ssn"}]}'), (2, "junk"), (3, '{"has_pii": false, "findings": []}')]
    verdicts = evaluate.audit_verdicts(spark.createDataFrame(rows, "fixture_id int, raw string"))
    got = {r.fixture_id: (r.has_pii, [tuple(f) for f in r.findings]) for r in verdicts.collect()}
    assert got == {1: (True, [("ssn", "unknown")]), 2: (True, [("audit_unavailable", "unknown")]), 3: (False, [])}
    fixtures = spark.createDataFrame([(1, "ssn 123-45-6789", ["ssn"], []), (2, "fine", [], []), (3, "ok", [], ["x"])], "fixture_id int, payload string, expected_regex_categories array<string>, expected_llm_categories array<string>")
    card = evaluate.audit_scorecard(fixtures, verdicts).first()
    assert (card.passed, card.failed, card.total) == (1, 2, 3)
    assert [r.complete for r in evaluate.redaction_recall(fixtures).orderBy("fixture_id").collect()] == [True, True, True]


def test_audit_reads_loose_json(spark):
    """A missing flag is false, values count as they do in Python, objects among the findings stay, their values as text."""
    cases = {
        '{"findings": []}': (False, []),
        '{"has_pii": true, "findings": [{"category": 3}, "x", {"category": null, "location": true}, {"location": "row 2"}]}': (True, [("3", "unknown"), ("None", "True"), ("unknown", "row 2")]),
        '{"has_pii": 0}': (False, []),
        '{"has_pii": 2, "findings": "none"}': (True, []),
        '{"has_pii": ""}': (False, []),
        '{"has_pii": "no"}': (True, []),
        '{"has_pii": null, "findings": null}': (False, []),
        '{"has_pii": []}': (False, []),
        '{"has_pii": {"a": 1}}': (True, []),
        "[1]": (True, [("audit_unavailable", "unknown")]),
    }
    rows = evaluate.audit_verdicts(spark.createDataFrame(list(enumerate(cases)), "fixture_id int, raw string")).orderBy("fixture_id").collect()
    assert [(r.has_pii, [tuple(f) for f in r.findings]) for r in rows] == list(cases.values())
