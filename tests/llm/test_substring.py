import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from clausemill.llm import substring
from oracle import compare


def plain(rows):
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


def corpus():
    rng = random.Random(3)
    passages = [[f"p{a}_{k}" for k in range(n)] for a, n in enumerate((12, 13, 14, 40, 90))]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(50)}" for _ in range(rng.randrange(40))]
        rows.append((i * 7, (" " if i % 2 else "\n").join(words)))
    return rows + [(1000, rows[20][1]), (1001, rows[20][1]), (1002, "same " * 40), (1003, "same " * 20)]


def test_against_plain(spark, documents):
    rows = corpus()
    expected = plain(rows)
    for batches, buckets in ((1, 3), (4, 2)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.deduplicated(documents(rows), buckets, batches).collect()}
        assert got == expected


def test_shuffled_flush_is_the_same(spark, documents, monkeypatch):
    monkeypatch.setattr(substring, "RUN_FILES", 0)
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.deduplicated(documents(rows), 2, 2).collect()}
    assert got == plain(rows)


def test_compaction_keeps_what_is_known(spark, documents):
    rows = corpus()
    index = substring.FingerprintIndex(spark, 2, fan_in=2)
    found = [index.add_batch(documents(part)) for part in (rows[:20], rows[20:40], rows[40:])]
    assert len(index.runs) == 2 and index.made == 4  # the first two runs became one
    index.close()
    places = {}
    for part in found:
        for r in part.collect():
            places.setdefault(r.doc_id, set()).add(r.place)
    expected = {i: n for i, (_, n, _) in plain(rows).items() if n}
    assert {i: substring.kept_words(dict(rows)[i], sorted(p))[1] for i, p in places.items()} == expected


def test_odd_rows(spark, odd):
    rows = substring.deduplicated(odd, 2).collect()
    assert len(rows) == odd.count() and all(r.n_removed == 0 for r in rows)
    assert substring.deduplicated(odd.limit(0), 2).count() == 0
    extra = odd.withColumnsRenamed({"lang": "place", "source": "anchor"})
    assert substring.deduplicated(extra, 2).columns == [*extra.columns, "n_words", "n_removed", "kept_text"]


def test_columns_of_any_name(spark, documents):
    rows = corpus()
    base = documents(rows).select("doc_id", "text")
    for c in ("_id", "_places", "places", "id", "row", "at_id", "N_words", "kept_text", "a.b"):
        base = base.withColumn(c, base.doc_id + 1)
    out = substring.deduplicated(base, 2)
    assert out.columns == ["doc_id", "text", "_id", "_places", "places", "id", "row", "at_id", "a.b", "n_words", "n_removed", "kept_text"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()} == plain(rows)
    assert all(r._id == r.doc_id + 1 == r["a.b"] for r in out.collect())


def test_compaction_is_not_a_shuffle(spark, documents):
    index = substring.FingerprintIndex(spark, 2)
    rows = corpus()
    index.add_batch(documents(rows[:30]))
    index.add_batch(documents(rows[30:]))
    plan = index._merged()._jdf.queryExecution().executedPlan().toString()
    index.close()
    assert "Exchange" not in plan


def test_query_against_sql(spark):
    compare(spark, substring.op2_substring_dedup, substring.ORACLES["op2_substring_dedup"])
    assert hashlib is not None


def test_windows_under_one_anchor_are_told_apart_by_64_bits(spark, documents):
    texts = ["a b c d e f g h i j k l " + f"m{k}" for k in range(300_000)]
    hashes = np.concatenate([substring.rolled(substring.Words(pa.array(texts[k : k + 10_000])).hashes(1), 13, 1)[::13] for k in range(0, len(texts), 10_000)])
    order = np.argsort(hashes)
    near = np.flatnonzero(np.diff(hashes[order] >> np.uint64(32)) == 0)
    anchor = lambda k: next(substring.entries(iter([pa.RecordBatch.from_pydict({"doc_id": [0], "text": [texts[k]]})]))).column("anchor")[0].as_py()
    pairs = [(order[k], order[k + 1]) for k in near if anchor(order[k]) == anchor(order[k + 1])]
    assert pairs  # equal anchors and equal upper halves of the signatures
    rows = [(2 * k + j, texts[i]) for k, pair in enumerate(pairs) for j, i in enumerate(pair)]
    assert all(r.n_removed == 0 for r in substring.deduplicated(documents(rows), 2, 1).collect())
