import hashlib
import re

import pytest
from pyspark.sql import functions as F

from clausemill.llm import fingerprints as fp
from oracle import compare


def hashes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return sorted(hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles)


def edit(text, following):
    text, half = text or "", len(text or "") // 2
    return text[: len(text) - half] + (following or "")[:half]


def near(a, b, k=fp.K):
    both = sorted({*a, *b})[:k]
    return sum(h in a and h in b for h in both) / len(both) if both else 1.0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    compare(spark, fp.op11_fingerprints, fp.ORACLES["op11_fingerprints"], f"/root/testdata/sf{sf}")


@pytest.mark.parametrize("ranges", [1, 2, 3, 50])
def test_next_document_across_ranges(spark, documents, ranges):
    """Every document meets the next one, whatever the ranges; ids are far apart and in no order."""
    texts = {(k * k * 37) % 10007 - 5000: f"text {k} " + "é " * (k % 7) + " ".join(f"w{k}x{j}" for j in range(k % 23)) for k in range(90)}
    found = {r.doc_id: r for r in fp.edited(documents(list(texts.items())).repartition(5), ranges=ranges).collect()}
    ids = sorted(texts)
    assert sorted(found) == ids
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        r, new = found[i], edit(texts[i], texts[j])
        assert (r.n_chars, r.edited) == (len(texts[i]), new)
        assert (r.sketch, r.edited_sketch, r.next_sketch) == (hashes(texts[i])[: fp.K], hashes(new)[: fp.K], hashes(texts[j])[: fp.K])


def test_ranges_of_repeated_ids(spark, documents):
    """Ids that fill many quantiles, and ranges that stay empty."""
    rows = [(5, f"copy {k % 3}") for k in range(40)] + [(1, "first one of all"), (9, "the last one")]
    found = fp.edited(documents(rows), ranges=16).collect()
    assert len(found) == len(rows)
    assert [r.edited for r in found if r.doc_id == 9] == [edit("the last one", "first one of all")]
    assert sum(r.edited == edit("copy 0", "the last one") or r.edited == edit("copy 1", "the last one") or r.edited == edit("copy 2", "the last one") for r in found if r.doc_id == 5) == 1


def test_odd_rows(spark, odd, documents):
    rows = fp.edited(odd.withColumn("edited", F.lit(1)).withColumn("range", F.lit(1)).withColumn("SKETCH", F.lit(1)))
    found = rows.collect()
    assert len(found) == odd.count() and fp.edited(odd.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    ids = sorted(texts)
    for r in found:
        if r.doc_id is None:
            assert r.next_sketch == [] and r.edited in (edit("a text with no id at all", ""), "")
        else:
            at = ids.index(r.doc_id)
            following = texts[ids[(at + 1) % len(ids)]]
            assert r.edited in (edit(texts[r.doc_id], following), edit(texts[r.doc_id], texts[r.doc_id]))
            assert r.sketch == hashes(texts[r.doc_id])[: fp.K]
    (one,) = fp.edited(documents([(3, "abcdef")])).collect()
    assert one.edited == "abcabc" and one.next_sketch == one.sketch


def test_estimates(spark, documents):
    """Estimates of large sets lie near the sets' own figures; those of small sets are exact."""
    a = [f"w{k}" for k in range(3000)]
    b = [f"w{k}" for k in range(1000, 2500)] + [f"v{k}" for k in range(700)]
    small, part = "one two three four five six seven", "two three four five six"
    pairs = spark.createDataFrame([(" ".join(a), " ".join(b)), (small, part), ("", small), ("", None), (small, small)], "a string, b string")
    s = pairs.select(fp.sketch(fp.words(F.col("a"))).alias("a"), fp.sketch(fp.words(F.col("b"))).alias("b"))
    got = s.select(fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("b"), F.col("a")).alias("c"), fp.distinct(F.col("a")).alias("d"), fp.hashes(fp.fingerprint(F.col("a"))).alias("back"), "a").collect()
    assert all(r.back == r.a for r in got)
    x, y = set(hashes(" ".join(a))), set(hashes(" ".join(b)))
    assert abs(got[0].r - len(x & y) / len(x | y)) < 0.12 and abs(got[0].c - len(x & y) / len(y)) < 0.15 and abs(got[0].d / len(x) - 1) < 0.3
    assert [(r.r, r.c, r.d) for r in got[1:]] == [(1 / 3, 1.0, 3.0), (0.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 1.0, 3.0)]


def test_merging_parts(spark, documents):
    """Sketches of parts merge to the sketch of the whole, for groups of any size, null and empty ones too."""
    rows = [(k, " ".join(f"w{(k * 7 + j) % 400}" for j in range(k % 60))) for k in range(120)]
    docs = documents(rows).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3))).unionByName(documents([(500, "")]).withColumn("source", F.lit("empty")))
    found = {r.source: r.fingerprint for r in fp.merged(fp.fingerprinted(docs), "source").collect()}
    expected = {"empty": ""}
    for key, rest in ((None, 0), ("s1", 1), ("s2", 2)):
        expected[key] = "".join(sorted({h for i, t in rows if i % 3 == rest for h in hashes(t)})[: fp.K])
    assert found == expected
    a, b = (fp.sketch(fp.words(F.lit(t))) for t in (rows[50][1], rows[59][1]))
    assert spark.range(1).select(fp.union(a, b).alias("u")).first().u == sorted({*hashes(rows[50][1]), *hashes(rows[59][1])})[: fp.K]


def test_merge_limits_before_the_shuffle(spark, documents):
    plan = fp.merged(fp.fingerprinted(documents([(1, "a b c")])), "source")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_one_shuffle_of_texts_and_no_python(spark):
    plan = fp.op11_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan and "Python" not in plan and "Arrow" not in plan
