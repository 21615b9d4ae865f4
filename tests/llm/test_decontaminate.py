import itertools
import random

from clausemill.llm import decontaminate as d
from oracle import compare


def test_masks_are_lossless():
    for bad in itertools.combinations(range(d.WINDOW), d.SUBSTITUTIONS):
        assert any(all(at + m not in bad for m in mask) for mask in d.MASKS for at in range(d.WINDOW - mask[-1]))


def test_substitutions(spark, documents):
    rng = random.Random(1)
    item = [f"i{k}" for k in range(30)]
    bench = spark.createDataFrame([(7, " ".join(item).upper()), (8, "too short an item"), (9, None), (10, "")], "item_id long, text string")
    rows, expected = [], set()
    for k in range(40):
        a = rng.randrange(0, 18)
        part = item[a : a + d.WINDOW]
        n = k % 5
        for at in rng.sample(range(d.WINDOW), n):
            part[at] = "zz"
        rows.append((k, " ".join(["x"] * rng.randrange(9) + part + ["y"] * rng.randrange(9))))
        if n <= d.SUBSTITUTIONS:
            expected.add(k)
    docs = documents(rows)
    for bound in (400_000, -1):
        d.BROADCAST_WORDS, kept = bound, d.BROADCAST_WORDS
        try:
            assert {r.doc_id for r in d.overlaps(docs, bench).collect()} == expected
        finally:
            d.BROADCAST_WORDS = kept
    assert {r.doc_id for r in d.decontaminated(docs, bench).collect()} == set(range(40)) - expected


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    assert d.overlaps(odd, bench).count() == 0
    assert d.decontaminated(odd, bench).count() == odd.count()
    assert d.overlaps(odd.limit(0), bench.limit(0)).count() == 0


def test_query_against_sql(spark):
    compare(spark, d.op9_decontaminate, d.ORACLES["op9_decontaminate"])


def test_plan_is_native(spark):
    plan = d.op9_decontaminate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
