import collections
import math
import re

import corpus_pipeline
from clausemill.llm import registry, toxicity
from pyspark.sql import functions as F
from test_jaccard import plain

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage on what its predecessor kept, against what it must do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"documents": {r.doc_id: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["decontaminate"]) < set(kept["substring"]) <= set(kept["jaccard"]) < set(kept["toxicity"]) < set(kept["documents"])
    assert not [t for t, n in collections.Counter(r.text for r in kept["jaccard"].values()).items() if n > 1]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, r in kept["substring"].items() if any(t in r.text for t in items)}
    assert held and held.isdisjoint(kept["decontaminate"])
    for i, r in kept["substring"].items():
        before = re.findall(r"[^\x20\x09-\x0D]+", kept["jaccard"][i].text)
        words = iter(before)
        assert r.n_chars == len(r.text) and all(w in words for w in re.findall(r"[^\x20\x09-\x0D]+", r.text))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == set(kept["decontaminate"])


def test_run_is_registered(spark):
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in registry.QUERIES} and "pipeline" in registry.QUERIES
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_toxicity_and_jaccard_stages_against_plain(spark):
    """The scores of every document, and all pairs of shingle sets, decide alike."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.saved(corpus_pipeline.drop_toxic(spark, docs, sf), "kept")
    model = toxicity.fit_tables(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    matcher = toxicity.Matcher(model.stems)
    clean = set()
    for r in docs.collect():
        z = sum(w * math.log1p(x) for w, x in zip(model.weights, matcher.sums(r.text or ""), strict=False)) + model.weights[-1]
        if z < 0:
            clean.add(r.doc_id)
    assert {r.doc_id for r in kept.collect()} == clean
    expected = {i for i, (_, component) in plain([(r.doc_id, r.text) for r in kept.collect()]).items() if i == component}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, kept, sf).collect()} == expected


def test_stages_on_odd_rows(spark, odd):
    """Null ids and texts, empty, blank and very long texts, repeated rows, clashing columns, and no rows at all."""
    more = odd
    for c in ("id", "n", "h", "component_id", "places", "row", "n_words", "n_removed", "kept_text", "sums", "score", "item_id", "words", "k"):
        more = more.withColumn(c, F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        rows, empty = stage(spark, more, SF), stage(spark, odd.limit(0), SF)
        assert rows.columns == empty.columns and empty.count() == 0
        got = collections.Counter((r.doc_id, getattr(r, "text", "")) for r in rows.collect())
        if name != "encode":
            assert tuple(rows.columns) == corpus_pipeline.COLUMNS
            assert got == collections.Counter((r.doc_id, r.text) for r in odd.collect()), name  # nothing here is toxic, near another, repeated or leaked
        else:
            assert collections.Counter(i for i, _ in got.elements()) == collections.Counter(r.doc_id for r in odd.collect())


def test_equal_texts_keep_the_smallest_id(spark, documents):
    text = " ".join(f"w{k}" for k in range(60))
    docs = documents([(9, text), (4, text), (7, text + " more"), (None, text)])
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 4]
    cut = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeated_passages(spark, docs, SF).collect()}
    assert cut == {None: (text, len(text)), 4: (text, len(text)), 7: ("more", 4)}
