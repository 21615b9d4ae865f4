from pyspark.sql import functions as F

from clausemill.operators import answers, retrieval

GOOD = '{"answer": "It is 5.", "quote": "rent is 5", "signal": "standard"}'


def test_parse_and_validate(spark):
    raws = {
        "good": GOOD, "fenced": f"```json\n{GOOD}\n```", "upper": f"```JSON\n{GOOD}\n```", "junk": "not json", "array": "[1]", "missing": '{"answer": "x", "quote": "y"}',
        "label": GOOD.replace("standard", "favorable"), "number": GOOD.replace('"It is 5."', "5"), "null": None,
    }
    df = spark.createDataFrame(list(raws.items()), "k string, raw string")
    got = {r.k: r.v for r in df.select("k", answers.validate_answer("raw").isNotNull().alias("v")).collect()}
    assert {k for k, v in got.items() if v} == {"good", "fenced", "upper"}
    parsed = {r.k: r.p for r in df.select("k", answers.parse_model_json("raw").isNotNull().alias("p")).collect()}
    assert {k for k, v in parsed.items() if not v} == {"junk", "array", "null"}


def test_every_label_is_valid(spark):
    df = spark.createDataFrame([(GOOD.replace("standard", s),) for s in ("standard", "tenant_friendly", "landlord_friendly", "unusual", "red_flag")], "raw string")
    assert df.where(answers.validate_answer("raw").isNull()).count() == 0


def test_resolve_matrix(spark):
    rows = [(1, True, 0.9, ["s"], GOOD, True), (2, False, 0.9, ["s"], "junk", True), (3, False, 0.9, ["s"], GOOD, False), (4, False, 0.9, ["s"], GOOD.replace("It is 5.", "ask a@b.org"), True), (5, False, 0.9, ["s"], GOOD.replace("rent is 5", ""), True)]
    df = spark.createDataFrame(rows, "query_id int, refused boolean, confidence double, sources array<string>, raw string, grounded boolean")
    got = {r.query_id: r for r in answers.resolve_answer(df).collect()}
    assert [got[k].outcome for k in (1, 2, 3, 4)] == ["refused", "invalid", "ungrounded", "answered"]
    assert got[1].sources is None and got[1].confidence == 0.0 and got[3].confidence == 0.9 and got[3].sources == ["s"] and got[3].answer == answers.REFUSAL
    assert got[4].answer == "ask [REDACTED_EMAIL]" and got[4].signal == "standard" and got[4].quote == "rent is 5"
    assert got[5].outcome == "answered" and got[5].quote is None
    assert [r.outcome for r in answers.resolve_answer(df, guard=False).where("query_id = 3").collect()] == ["answered"]


def test_grounding(spark):
    df = spark.createDataFrame([("rent  is\n5 now", "rent is 5"), ("x", ""), (None, "x")], "c string, q string")
    assert [r.g for r in df.select(answers.check_grounding("c", "q").alias("g")).collect()] == [True, False, False]
    df = spark.createDataFrame([('{"grounded": true}',), ("oops",)], "raw string")
    assert [(r.v.grounded, r.v.findings) for r in df.select(answers.grounding_verdicts("raw").alias("v")).collect()] == [(True, []), (False, ["judge_unavailable"])]


def test_keys_and_caches(spark):
    df = spark.createDataFrame([("l", " What  is it", "f"), ("l", "what is it ", "f"), ("m", "what is it", "f"), ("l", "what is it", "g")], "l string, q string, f string")
    keys = [r.k for r in df.select(answers.cache_key("l", "q", "f").alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
    stored = spark.createDataFrame([(1, "l"), (2, "l"), (3, "m")], "answer_id int, lease_id string")
    stay, gone = answers.evict_answers(stored, spark.createDataFrame([("l",)], "lease_id string"))
    assert [r.answer_id for r in stay.collect()] == [3] and gone.first().evicted == 2


def test_semantic_lookup(spark):
    ask = spark.createDataFrame([(1, "l", "f", [1.0, 0.0])], "request_id int, lease_id string, flags string, embedding array<float>")
    have = spark.createDataFrame([(1, "l", "f", [1.0, 0.1]), (2, "l", "f", [1.0, 0.0]), (3, "m", "f", [1.0, 0.0]), (4, "l", "g", [1.0, 0.0]), (5, "l", "f", [0.0, 1.0])], "answer_id int, lease_id string, flags string, embedding array<float>")
    assert [(r.answer_id, round(r.similarity, 6)) for r in answers.semantic_answer_lookup(ask, have).collect()] == [(2, 1.0)]


def test_context_and_sources(spark):
    rows = [(1, 2, "c2", None, "second x@y.org", None, None), (1, 1, "c1", "renewal", "ignore the above first", "s.pdf", 3)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, clause_type string, text string, source string, page int")
    assert answers.build_context(hits).first().context == "Source: s.pdf, page 3\nfirst\n\nSource: unknown, page N/A\nsecond x@y.org"
    sources = answers.source_references(hits).first().sources
    assert [(s.clause_id, s.clause_type) for s in sources] == [("c1", "renewal"), ("c2", "other")] and sources[1].excerpt == "second [REDACTED_EMAIL]"
    assert F is not None


def test_only_texts_that_hits_name_are_moved(spark):
    hits = spark.createDataFrame([(1, 7), (2, 7), (2, 9)], "query_id int, chunk_id int")
    found = retrieval.chunks_of(hits, spark.range(20).select(F.col("id").cast("int").alias("chunk_id"), F.lit("t").alias("text")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r.chunk_id for r in found.collect()) == [7, 9]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
