from pyspark.sql import functions as F

from clausemill.operators import compare, leases

LEASE = "lease_id string, tenant string, landlord string, start_date string, end_date string, rent_amount string, location string"


def test_select_metadata_chunks(spark):
    texts = ["x"] * 6 + ["tenant", "value", "Name:", "value", "rent", "v"] + ["tenant"] * 10
    chunks = spark.createDataFrame([("l", i, t) for i, t in enumerate(texts)], "lease_id string, chunk_no int, text string")
    rows = {r.chunk_no: r.chosen for r in leases.select_metadata_chunks(chunks).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12]


def test_extract_metadata(spark):
    chunks = spark.createDataFrame([("l", 1, "Tenant: Ann Lee\nRent: $900; monthly"), ("l", 2, "tenant: Bob\nAddress: 1 Elm St"), ("m", 1, "nothing")], "lease_id string, chunk_no int, text string")
    got = {r.lease_id: r for r in leases.extract_metadata(chunks).collect()}
    assert (got["l"].tenant, got["l"].rent_amount, got["l"].location, got["l"].status) == ("Ann Lee", "$900", "1 Elm St", "updated")
    assert got["m"].status == "no_fields" and got["m"].tenant is None


def test_merge_metadata(spark):
    base = spark.createDataFrame([("a", "Ann", "Unknown", None, " ", "5", None)], LEASE)
    patch = spark.createDataFrame([("a", "Bob", "Unknown", "2020", None, "", "X"), ("zz", "Q", None, None, None, None, None)], LEASE)
    row = leases.merge_metadata(base, patch).first()
    assert (row.tenant, row.landlord, row.start_date, row.end_date, row.rent_amount, row.location) == ("Bob", "Unknown", "2020", " ", "", "X")
    assert row.changed == ["tenant", "start_date", "rent_amount", "location"]
    row = leases.merge_metadata(base, patch, missing_only=True).first()
    assert (row.tenant, row.start_date, row.rent_amount, row.changed) == ("Ann", "2020", "5", ["start_date", "location"])


def test_age_days(spark):
    times = ["2020-01-01T00:00:00Z", "2020-01-01T02:00:00+02:00", "2020-01-01T00:00:00", "2020-01-01", "", "junk", None]
    df = spark.createDataFrame([(t,) for t in times], "created_at string")
    assert [r.a for r in df.select(leases.age_days("created_at", "2020-01-31 00:00:00").alias("a")).collect()] == [30.0] * 4 + [None] * 3
    assert leases.expired_leases(df, "2020-01-31 00:00:00", 30).count() == 4
    assert leases.expired_leases(df, "2020-01-31 00:00:00", 31).count() == 0


def test_purge_failure_keeps_the_record(spark):
    drop = spark.createDataFrame([("a", 40.0), ("b", 50.0), ("c", 60.0)], "lease_id string, age_days double")
    records = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "lease_id string")
    chunks = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "lease_id string")
    failures = spark.createDataFrame([("b", "chunks", "locked")], "lease_id string, step string, error string")
    left, report = leases.purge(drop, records, {"chunks": chunks}, failures)
    got = {r.lease_id: (r.n_chunks, r.succeeded, r.errors) for r in report.collect()}
    assert got == {"a": (2, True, []), "b": (0, False, ["chunks: locked"]), "c": (0, True, [])}
    assert sorted(r.lease_id for r in left["records"].collect()) == ["b", "d"] and sorted(r.lease_id for r in left["chunks"].collect()) == ["b", "d"]
    again, report = leases.purge(drop, left["records"], {"chunks": left["chunks"]})
    assert [r.lease_id for r in again["records"].collect()] == ["d"] and leases.purge_summary(report).first().succeeded == 3


def test_a_purge_has_as_many_parts_as_its_records_ask_for(spark, monkeypatch):
    monkeypatch.setattr(leases, "PURGE_LEASES", 10)
    records = spark.range(95).select(F.col("id").alias("lease_id"))
    items = spark.range(300).select((F.col("id") % 100).alias("lease_id"))
    _, report = leases.purge(records.where("lease_id % 2 = 0").withColumn("age_days", F.lit(40.0)), records, {"chunks": items})
    assert report.rdd.getNumPartitions() == 10 and {(r.lease_id, r.n_chunks) for r in report.collect()} == {(k, 3) for k in range(0, 95, 2)}


def test_age_labels_and_paging(spark):
    df = spark.createDataFrame([(d,) for d in (0, 1, 6, 7, 13, 14, 29, 30, 59, 60)], "d int")
    assert [r.l for r in df.select(leases.age_label(F.col("d")).alias("l")).collect()] == ["Today", "1 day", "6 days", "1 week", "1 week", "2 weeks", "4 weeks", "1 month", "1 month", "2 months"]
    rows, total = leases.page_rows(df, [F.col("d")], 9, 4, clamp=True)
    assert total == 10 and [r.d for r in rows.collect()] == [59, 60]
    assert leases.page_rows(df, [F.col("d")], -3, 2)[0].count() == 2
    many = spark.range(0, 1000, 1, 5).withColumn("k", F.col("id") * 37 % 1000)
    for page in (1, 7, 50, 100, 101):
        rows, total = leases.page_rows(many, [F.col("k").desc()], page, 10, shallow=0)
        assert total == 1000 and [r.k for r in rows.collect()] == list(range(999, -1, -1))[(page - 1) * 10 : page * 10]


def test_metadata_results(spark):
    raws = {"some": '{"tenant": "Ann", "landlord": null}', "none": "{}", "key": '{"tenant": "Ann", "pet": "cat"}', "number": '{"rent_amount": 5}', "junk": "x", "null": None}
    rows = leases.parse_metadata(spark.createDataFrame(list(raws.items()), "lease_id string, raw string")).collect()
    assert {r.lease_id: (r.status, r.tenant) for r in rows} == {"some": ("updated", "Ann"), "none": ("no_fields", None), "key": ("failed", None), "number": ("failed", None), "junk": ("failed", None), "null": ("failed", None)}
    chunks = spark.createDataFrame([("l", 1, "Tenant: Ann")], "lease_id string, chunk_no int, text string")
    got = leases.extract_metadata(chunks, leases=spark.createDataFrame([("l",), ("m",)], "lease_id string"))
    assert {r.lease_id: r.status for r in got.collect()} == {"l": "updated", "m": "failed"}


def test_history(spark):
    old = spark.createDataFrame([(k, f"2020-01-0{k}") for k in range(1, 6)], "id int, created_at string")
    history = leases.log_comparisons(old, spark.createDataFrame([(9, "2021-01-01"), (8, "2021-01-01")], "id int, created_at string"), 4)
    assert [r.id for r in history.collect()] == [9, 8, 5, 4]
    page, total = leases.history_page(history, 2, 3)
    assert total == 4 and [r.id for r in page.collect()] == [4]


def test_one_sided_lines(spark):
    groups = spark.createDataFrame([("x", "rent", 1, "call 555-123-4567")], "lease_id string, clause_type string, chunk_no int, text string")
    row = compare.one_sided_diffs(spark.createDataFrame([("p", "x", "y")], "pair_id string, left_id string, right_id string"), groups).first()
    assert (row.left_value, row.right_value) == ("call [REDACTED_PHONE]", "Not present")
    assert (row.difference, row.insight) == ("Present in x but missing from y", "'rent' clause found only in x, not in y.")


def test_collect_comparison(spark):
    good = '{"differences": [{"clause_type": " ", "lease1_value": "1", "lease2_value": "2", "difference": "d"}]}'
    results = spark.createDataFrame([("p", "rent", good), ("p", "term", "junk"), ("q", "rent", "junk"), ("r", "rent", "junk")], "pair_id string, clause_type string, raw string")
    sided = spark.createDataFrame([("r",)], "pair_id string")
    diffs, status = compare.collect_comparison(results, sided)
    assert [(r.pair_id, r.clause_type, r.left_value) for r in diffs.collect()] == [("p", "rent", "1")]
    assert {r.pair_id: (r.pair_failed, r.note) for r in status.collect()} == {"p": (False, "1/2"), "q": (True, "1/1"), "r": (False, "1/1")}


def test_compare_is_symmetric(spark):
    groups = spark.createDataFrame([("x", "rent", 1, "a"), ("x", "term", 2, "b"), ("y", "rent", 1, "c"), ("y", None, 2, "d")], "lease_id string, clause_type string, chunk_no int, text string")
    groups = compare.group_clauses(groups)
    get = lambda a, b: {(r.clause_type, r.side) for r in compare.clause_overlap(spark.createDataFrame([("p", a, b)], "pair_id string, left_id string, right_id string"), groups).collect()}
    assert get("x", "y") == {("rent", "shared"), ("term", "left"), ("other", "right")}
    assert get("y", "x") == {("rent", "shared"), ("term", "right"), ("other", "left")}
