import hashlib
import hmac
import os

import pytest
from pyspark.sql import functions as F

from clausemill import registry
from clausemill.functions import redaction
from clausemill.functions.text import hash_query
from oracle import SF, compare

POSITIVE = {
    "ssn 123-45-6789": "SSN", "card 4111 1111 1111 1111": "CREDIT_CARD", "Account # 12345678-90": "ACCOUNT_NUMBER", "Routing: 123456789": "ACCOUNT_NUMBER", "ABA: 123456789": "ACCOUNT_NUMBER", "ACH Account: 123456789": "ACCOUNT_NUMBER", "Bank Account: 12345 67890 12": "ACCOUNT_NUMBER", "Pay to A/C 1234-5678-9012": "ACCOUNT_NUMBER", "IBAN DE44500105175407324931": "ACCOUNT_NUMBER", "mail a.b@c.org": "EMAIL", "call 555-123-4567": "PHONE",
    "at 12 North Elm Street": "STREET_ADDRESS", "Date of birth: 01/02/1980": "DATE_OF_BIRTH", "born 1980": "DATE_OF_BIRTH", "DOB is 01/02/1990": "DATE_OF_BIRTH", "Birthday: 12 January 1980": "DATE_OF_BIRTH", "DOB 1971-07-04 listed": "DATE_OF_BIRTH", "Date of Birth: March 14, 1985": "DATE_OF_BIRTH",
    "12 Oak Circle": "STREET_ADDRESS", "742 Evergreen Terrace": "STREET_ADDRESS", "Tenant: José García-López Jr.": "PERSON_NAME", "LANDLORD: MARY O'NEIL": "PERSON_NAME", "Owner: Jane Smith": "PERSON_NAME", "Agent: Robert Brown": "PERSON_NAME", "Renter: Ana Lopez": "PERSON_NAME", "Landlady: Ruth May": "PERSON_NAME", "Tenant - John Smith": "PERSON_NAME", "landlord: jane smith": "PERSON_NAME", "Co-tenant: Émilie Lefèvre": "PERSON_NAME", "Landlord's representative: Max Muster": "PERSON_NAME",
}
NEGATIVE = ["Reference number: AB12345678", "PO: ORD-12345", "January 1, 2025", "Term: 03/14/2025 to 03/14/2026", "signed on 01/02/2020", "from 2020-01-01 to 2021-01-01", "order 12345", "Mary Smith walked home", "section 8.2", "account is closed"]


def redacted(spark, texts):
    return [r.r for r in spark.createDataFrame([(t,) for t in texts], "text string").select(redaction.redact_pii("text").alias("r")).collect()]


def test_redaction(spark):
    for text, out in zip(POSITIVE, redacted(spark, list(POSITIVE)), strict=True):
        assert f"[REDACTED_{POSITIVE[text]}]" in out, (text, out)
    assert redacted(spark, NEGATIVE) == NEGATIVE
    assert redacted(spark, ["(555) 123-4567", None, "TENANT: John Doe, Jr. signed"]) == ["([REDACTED_PHONE]", None, "[REDACTED_PERSON_NAME] signed"]


def test_redact_nested(spark):
    df = spark.sql("SELECT 5 AS n, CAST(NULL AS STRING) AS z, named_struct('a', array(map('k', 'x@y.org'))) AS s, CAST(NULL AS STRUCT<q:STRING>) AS e")
    row = redaction.redact_nested(df).first()
    assert (row.n, row.z, row.s.a, row.e) == ("5", None, [{"k": "[REDACTED_EMAIL]"}], None)


def test_sanitize(spark):
    texts = ["please Ignore  all previous words", "xsystem: y", "keep this", "a" * 5000, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.s for r in df.select(redaction.sanitize_chunk("text").alias("s")).collect()] == ["please  words", "x y", "keep this", "a" * 2000, None]
    assert df.select(redaction.sanitize_chunk("text", enabled=False).alias("s")).first().s == texts[0]
    assert [r.f for r in df.select(redaction.flag_injection("text").alias("f")).collect()] == [True, True, False, False, False]


def test_hash_query(spark):
    df = spark.createDataFrame([("Què?",), ("",), (None,)], "q string")
    expected = hmac.new(b"salt", "Què?".encode(), hashlib.sha256).hexdigest()[:16]
    assert [r.h for r in df.select(hash_query("q", "salt").alias("h")).collect()] == [expected, "", ""]


def test_scan(spark):
    df = spark.createDataFrame([(1, "ok\nAPP_SECRET = abcdefgh1\nAuthorization: Bearer abcdefghijklmnop1\n  /s/ Ann Lee\nacct AB12345678\nMY_API_KEY=abcdefgh\nBy: ann lee"), (2, "clean")], "id int, text string")
    rows = redaction.scan_lines(df, "id").collect()
    assert {(r.id, r.line_no, r.rule) for r in rows} == {(1, 2, "password_assignment"), (1, 3, "bearer_token"), (1, 4, "signature"), (1, 5, "account_number"), (1, 6, "password_assignment"), (1, 7, "signature")}
    assert all("abc" not in r.excerpt for r in rows)
    assert {(r.id, r.findings, r.clean) for r in redaction.scan_gate(redaction.scan_lines(df, "id"), df, "id").collect()} == {(1, 6, False), (2, 0, True), (None, 6, False)}
    assert redaction.pii_profile(df.select("id", F.lit("a@b.co c@d.co").alias("text")), "id").first().hits == 2


def test_anchors_lose_no_match(spark):
    """Rules behind their anchors give what all rules in turn give."""
    texts = [*POSITIVE, *NEGATIVE, "pay \u0665\u0665\u0665-\u0665\u0665-\u0665\u0665\u0665\u0665", "swift ABCDEFGH and tenant\u00a0:\u00a0Ann", "\u0131ban abcdefgh", "agent-Bob Lee. mail x@y.zz", "", "\u212aoo: 12 Oak Lane"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.col("text")
    for name, pattern in redaction.PII_RULES.items():
        plain = F.regexp_replace(plain, "(?iU)" + pattern, f"[REDACTED_{name.upper()}]")
    rows = df.select("text", redaction.redact_pii("text").alias("r"), plain.alias("p")).collect()
    assert [r.r for r in rows] == [r.p for r in rows] and sum(r.r != r.text for r in rows) > 20
    assert redacted(spark, [None]) == [None]


def test_scan_names_keys_and_variables(spark):
    lines = {
        "gsk_abcdefghijklmnop1": "groq_api_key", "x pk-lf-0123abcd-wxyz": "langfuse_public_key", "sk-lf-0123ABCD-wx_y-z": "langfuse_secret_key", "LANGFUSE_NEXTAUTH_SECRET=0123456789abcdef": "langfuse_nextauth_secret",
        "LANGFUSE_CLICKHOUSE_PASSWORD = abcd": "langfuse_clickhouse_password", "LANGFUSE_MINIO_ROOT_PASSWORD=abcd": "langfuse_minio_root_password", "LANGFUSE_REDIS_AUTH=abcd": "langfuse_redis_auth", "gsk_short": None, "pk-lf-0123abc-wxyz": None,
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "id int, text string")
    found = {}
    for r in redaction.scan_lines(df, "id").collect():
        found.setdefault(r.id, set()).add(r.rule)
    for k, rule in enumerate(lines.values()):
        assert (rule in found[k]) if rule else k not in found


def test_ascii_edges(spark):
    """In SQL's patterns a letter beyond ASCII ends a word, and only ASCII's digits and blanks count."""
    texts = ["at 12 gein Stää zu", "12 Elm Street", "no ٥٥٥-٥٥-٥٥٥٥", "tenant: Ann Lee\n", "12 Elm Street"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.r for r in df.select(redaction.redact_pii("text", ascii=True).alias("r")).collect()] == ["at [REDACTED_STREET_ADDRESS]ää zu", *texts[1:3], "[REDACTED_PERSON_NAME]\n", "[REDACTED_STREET_ADDRESS]"]
    assert redacted(spark, texts[:1]) == texts[:1]


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Test tables whose texts hold words that SQL cuts at letters beyond ASCII."""
    import duckdb

    at = tmp_path_factory.mktemp("edges")
    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", at / name)
    (at / "documents.parquet").unlink()
    ends = "[' 7 gein. Stää zu ü', ' 12 Oak Lané', ' 9 Elm Stß. x', ' ñ123-45-6789', '', chr(10) || 'Signed: Ann Lee' || chr(10) || 'éacct AB12345678']"
    duckdb.sql(f"COPY (SELECT * REPLACE (left(text, 400) || {ends}[doc_id % 6 + 1] AS text) FROM '{SF}/documents.parquet') TO '{at}/documents.parquet' (FORMAT parquet)")
    return str(at)


def same_as_sql(spark, edges, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], edges)


def test_redact_pii_as_its_sql(spark, edges):
    same_as_sql(spark, edges, "c1_redact_pii")


def test_list_chunks_as_its_sql(spark, edges):
    same_as_sql(spark, edges, "b10_list_chunks")


def test_audit_scorecard_as_its_sql(spark, edges):
    same_as_sql(spark, edges, "c10_audit_scorecard")


def test_redaction_recall_as_its_sql(spark, edges):
    same_as_sql(spark, edges, "c11_redaction_recall")


def test_redact_nested_as_its_sql(spark, edges):
    same_as_sql(spark, edges, "c2_redact_nested")


def test_pii_profile_as_its_sql(spark, edges):
    same_as_sql(spark, edges, "c3_pii_profile")


def test_scan_lines_as_its_sql(spark, edges):
    same_as_sql(spark, edges, "c4_scan_lines")


@pytest.mark.parametrize("name", ["e2_source_references", "f17_one_sided_diffs"])
def test_excerpts_as_their_sql(spark, edges, name):
    same_as_sql(spark, edges, name)
