import collections
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from clausemill.llm import bpe, token_rollups
from clausemill.llm.tables import new_path

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHANGES = "doc_id long, tokenizer string, source string, lang string, n_tokens long, deleted boolean"


def totals(store):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_signed_deltas(spark):
    store = token_rollups.TokenRollups(spark, new_path(spark, "t"))
    assert totals(store) == {}
    first = spark.createDataFrame([(1, "t", "a", "en", 5, False), (2, "t", "a", None, 7, False), (2, "t", "a", None, 6, None), (None, "t", "a", "en", 1, False), (9, "t", "b", "en", None, True)], CHANGES)
    assert store.commit("one", first) and not store.commit("one", first)
    assert totals(store) == {("a", "en"): (2, 6), ("a", None): (1, 7)}
    assert store.commit("two", spark.createDataFrame([(1, "t", "b", "en", 9, False), (2, "t", None, None, 0, True), (3, "t", "b", "en", 4, False)], CHANGES))
    assert totals(store) == {("a", "en"): (1, 1), ("a", None): (0, 0), ("b", "en"): (2, 13)}
    assert store.committed() == ["one", "two"]


def test_an_unfinished_commit_is_replaced(spark):
    path = new_path(spark, "t")
    store = token_rollups.TokenRollups(spark, path)
    rows = spark.createDataFrame([(1, "t", "a", "en", 5, False)], CHANGES)
    rows.withColumn("seq", F.lit(0).cast("long")).write.parquet(f"{path}/ledger/one")  # written, never committed
    assert totals(store) == {} and store.commit("one", rows) and totals(store) == {("a", "en"): (1, 5)}


def test_query_against_plain(spark, odd):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    sf = "/root/testdata/sf0.001"
    expected = collections.defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        for name, count in (("words", n), ("byte_bpe_50k", len(encoding.encode_ordinary(r.text or "")))):
            expected[r.source, r.lang, name][0] += 1
            expected[r.source, r.lang, name][1] += count
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in token_rollups.op8_token_counts(spark, sf).collect()}
    assert got == dict(expected)
    assert token_rollups.rolled_up(odd, PATH, new_path(spark, "t")).totals().count() == 2
    assert token_rollups.rolled_up(odd.limit(0), PATH, new_path(spark, "t")).totals().count() == 0


def test_every_row_ends_at_its_exact_counts(spark, odd):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    rows = odd.collect()
    texts = [r.text or "" for r in rows if r.doc_id is None] + list({r.doc_id: r.text or "" for r in rows if r.doc_id is not None}.values())
    got = {r.tokenizer: (r.n_docs, r.n_tokens) for r in token_rollups.rolled_up(odd, PATH, new_path(spark, "t")).totals().collect()}
    assert got == {"words": (len(texts), sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts)), "byte_bpe_50k": (len(texts), sum(len(encoding.encode_ordinary(t)) for t in texts))}


def test_deleted_documents_come_again(spark):
    store = token_rollups.TokenRollups(spark, new_path(spark, "t"))
    rows = spark.createDataFrame([(1, "t", "a", "en", 5, False), (2, "t", "a", "en", 0, False), (None, "t", "a", "en", 3, False)], CHANGES)
    named = rows.where("doc_id is not null")
    store.commit("insert", rows)
    store.commit("withdraw", named.withColumn("deleted", F.lit(True)))
    assert totals(store) == {("a", "en"): (1, 3)}
    store.commit("restore", named)
    assert totals(store) == {("a", "en"): (3, 8)}


def test_a_base_replaces_what_came_before(spark):
    path = new_path(spark, "t")
    store = token_rollups.TokenRollups(spark, path)
    store.compact()
    store.commit("one", spark.createDataFrame([(1, "t", "a", "en", 5, False), (2, "t", "a", "en", 6, False), (None, "t", "a", "en", 3, False)], CHANGES))
    store.commit("two", spark.createDataFrame([(2, "t", "a", "en", 0, True)], CHANGES))
    before = totals(store)
    store.compact()
    assert totals(store) == before == {("a", "en"): (2, 8)} and store._base() == 2
    store._fs.delete(store._path(f"{path}/ledger/one"), True)
    store._fs.delete(store._path(f"{path}/deltas/one"), True)
    assert not store.commit("one", spark.createDataFrame([(7, "t", "a", "en", 1, False)], CHANGES))
    assert store.commit("three", spark.createDataFrame([(1, "t", "b", "en", 9, False), (2, "t", "a", "en", 4, False)], CHANGES))
    assert totals(store) == {("a", "en"): (2, 7), ("b", "en"): (1, 9)}
