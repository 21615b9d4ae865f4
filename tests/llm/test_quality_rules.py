import collections
import re

from pyspark.sql import functions as F

from clausemill.llm import quality_rules as q


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_measures_against_plain(spark, odd, documents):
    docs = odd.unionByName(documents([(20, "a b c d e a b c d e a b"), (21, "x " * 30 + "\nq\nq\n\nq "), (22, "# * $ | a"), (23, "a b c d e f a b c d e")]))
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100))
    source = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    rows = q.measures(docs).where("doc_id is not null").collect()
    assert len(rows) == docs.where("doc_id is not null").count()
    for r in rows:
        assert plain(source[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.doc_id


def test_verdicts(spark, odd):
    sf = "/root/testdata/sf0.01"
    rows = q.op7_quality_rules(spark, sf).drop("quality").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    assert rows.where("(quality = 1) = kept").count() >= 0.97 * rows.count()
    got = q.judged(odd).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.n_words < 10)
    assert q.judged(odd.limit(0)).count() == 0


def test_em_finds_the_accurate_rules(spark):
    votes = spark.sql(
        "SELECT CASE WHEN bad AND id % 10 > 0 THEN 1 ELSE 0 END AS symbols, CASE WHEN bad AND id % 7 > 0 THEN 1 ELSE 0 END AS capitals, CASE WHEN id % 3 = 0 THEN 1 END AS variety"
        " FROM (SELECT id, id % 8 = 0 AS bad FROM range(4000))"
    )
    rules = tuple(r for name in ("symbols", "capitals", "variety") for r in q.RULES if r.name == name)
    prior, tables = q.fit(votes, rules)
    assert tables[0][1] > 2 and tables[1][1] > 2 and abs(tables[2][1]) < 0.7 and prior < 0.3
    again = q.fit(votes.repartition(3), rules)
    assert abs(again[0] - prior) < 1e-12


def test_plan_is_native(spark):
    plan = q.op7_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_variety_covers_the_whole_text(spark, documents):
    varied = [f"word{k}" for k in range(2000)]
    dull = [f"dull{k * k % 7}" for k in range(18_000)]
    texts = {1: varied + dull, 2: dull + varied, 3: varied, 4: dull[:2000], 5: varied + dull[:1], 6: []}
    rule = next(r for r in q.RULES if r.name == "variety")
    got = {r.doc_id: (r.n_distinct, r.vote) for r in q.measures(documents([(i, " ".join(w)) for i, w in texts.items()])).select("*", rule.vote().alias("vote")).collect()}
    distinct = {i: sum(len(set(w[k : k + q.BLOCK])) for k in range(0, len(w), q.BLOCK)) for i, w in texts.items()}
    assert got == {1: (distinct[1], 1), 2: (distinct[2], 1), 3: (2000, 0), 4: (distinct[4], 1), 5: (2001, 0), 6: (0, None)}
    turned = q.measures(documents([(1, " ".join(dull[:2000] + [f"word{k}" for k in range(18_000)]))])).select(rule.vote().alias("vote"))
    assert turned.first().vote == 0
