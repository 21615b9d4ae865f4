"""Lexical and dense retrieval, fusion, reranking and the refusal gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausemill.functions.text import tokens
from clausemill.functions.vectors import cosine, dot, norm
from clausemill.sources.tables import new_path, saved

from .lexical_index import Bm25, LexicalIndex, best_in_blocks, bm25_weight
from .vector_search import VectorIndex, tiled_topk

TOP, CANDIDATES, ALPHA, THRESHOLD = 5, 20, 0.5, 0.55
#: Query rows up to this many are sent to every executor; more are joined by a shuffle.
BROADCAST_QUERIES = 20_000
#: Ids up to this many are sent to every executor (some 32 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Vectors that ask are sent to every executor up to so many, and up to so many bytes; they are compared one by one with every vector, while tiles are multiplied.
BROADCAST_ASKS, BROADCAST_BYTES = 512, 32 << 20


def bounded(queries: DataFrame) -> DataFrame:
    """The queries, marked for broadcast if few."""
    return F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries


def chunks_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that some hit names; no other chunk's text is shuffled or sorted."""
    ids = saved(hits.select("chunk_id").distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return chunks.join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")


def build_bm25(chunks: DataFrame) -> Bm25:
    """The Okapi index of each lease of (lease_id, chunk_id, text), in a folder of its own."""
    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("lease_id", "chunk_id")}
    index = LexicalIndex(chunks.sparkSession, new_path(chunks.sparkSession, "bm25"), kind["lease_id"], kind["chunk_id"])
    index.update(chunks, 0)
    return index.read()


def ranked(scores: DataFrame, k: int, order: Column) -> DataFrame:
    """The first ``k`` of each query, with ``rank`` from 1; ties by chunk_id."""
    w = Window.partitionBy("query_id").orderBy(order, "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_topk(questions: DataFrame, index: Bm25, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, score, rank); repeated query words count again and chunks without a match score 0.

    ``questions`` has query_id, question and lease_id.  Matches are ranked first;
    zero-score chunks fill up only for queries with fewer than ``k`` matches, and
    then only the first ``k`` of the lease.  Of the index only the questions' terms
    are weighed, in blocks of chunks, of which each sends on its best.
    """
    chunks = index.chunks
    terms = questions.select("query_id", "lease_id", F.explode(tokens("question")).alias("term")).groupBy("query_id", "lease_id", "term").agg(F.count("*").alias("times"))
    # the questions' terms with their weights are a small table, which meets the chunks once
    asked = saved(index.idf.join(bounded(terms), ["lease_id", "term"]), "asked")

    def matches(asked: DataFrame) -> DataFrame:
        return index.tf.join(bounded(asked), ["lease_id", "term"]).groupBy("query_id", "lease_id", "chunk_id").agg(F.sum(bm25_weight() * F.col("times")).alias("score"))

    columns = ["query_id", "chunk_id", "score", "rank"]
    best = F.round("score", 9).desc()
    small = asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    hits = best_in_blocks(index, asked.toArrow(), k, questions.schema["query_id"].dataType.simpleString()) if small else matches(asked)
    top = saved(ranked(hits, k, best).select(*columns), "lexical")
    found = top.where(F.round("score", 9) > 0).groupBy("query_id").agg(F.count("*").alias("found"))
    few = questions.select("query_id", "lease_id").join(found, "query_id", "left").where(F.coalesce("found", F.lit(0)) < k).select("query_id", "lease_id")
    few = saved(few, "few")
    if not few.limit(1).count():
        return top
    own = saved(matches(asked.join(bounded(few.select("query_id")), "query_id", "left_semi")), "matches")
    # chunks beyond the first k plus the query's own matches can never be among its zero scores
    most = own.groupBy("query_id").agg(F.count("*").alias("own")).agg(F.coalesce(F.max("own"), F.lit(0))).first()[0]
    order = Window.partitionBy("lease_id").orderBy("chunk_id")
    heads = chunks.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + most).drop("at")
    zero = heads.join(bounded(few), "lease_id").join(own.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "lease_id", "chunk_id", F.lit(0.0).alias("score"))
    filled = ranked(own.unionByName(zero), k, best).select(*columns)
    return top.join(few.select("query_id"), "query_id", "left_anti").select(*columns).unionByName(filled)


def dense_topk(queries: DataFrame, candidates: DataFrame, k: int = TOP, itself: bool = False) -> DataFrame:
    """Exact: (query_id, chunk_id, distance, rank), distance 1 - cosine within the query's lease; a chunk asked by its own id only if ``itself``.

    A few questions go to every task of the candidates, by their number and the bytes
    that they take; more are multiplied with the candidates in tiles.
    """
    wide = "array<double>"
    asked = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding") * 8 + 64), F.lit(0)).alias("bytes")).first()
    if asked.n > BROADCAST_ASKS or asked.bytes > BROADCAST_BYTES:
        return tiled_topk(queries, candidates, k, itself)
    asks = queries.select("query_id", "lease_id", F.col("embedding").cast(wide).alias("q"), norm(F.col("embedding")).alias("qn"))
    own = candidates.select("lease_id", "chunk_id", F.col("embedding").cast(wide).alias("c"), norm(F.col("embedding")).alias("cn"))
    rows = own.join(F.broadcast(asks), "lease_id")
    usable = (F.size("q") == F.size("c")) & (F.col("qn") * F.col("cn") > 0)
    near = F.coalesce(F.when(usable, dot(F.col("q"), F.col("c")) / (F.col("qn") * F.col("cn"))), F.lit(0.0))
    rows = rows if itself else rows.where("query_id <> chunk_id")
    return ranked(rows.select("query_id", "chunk_id", (1 - near).alias("distance")), k, F.round("distance", 9).asc())


def dense_topk_approx(queries: DataFrame, candidates: DataFrame, k: int = TOP, itself: bool = False) -> DataFrame:
    """As ``dense_topk`` by a coarse index, built for this search in a folder of its own."""
    kind = {c: candidates.schema[c].dataType.simpleString() for c in ("lease_id", "chunk_id")}
    index = VectorIndex(candidates.sparkSession, new_path(candidates.sparkSession, "vectors"), kind["lease_id"], kind["chunk_id"])
    index.fit(candidates, k=k)
    index.update(candidates, 0)
    return index.search(queries, k, itself=itself)


def normalize(scores: DataFrame, column: str) -> DataFrame:
    """Min-max scaling inside each query; all equal gives 0."""
    w = Window.partitionBy("query_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return scores.withColumn("scaled", F.when(high == low, 0.0).otherwise((F.col(column) - low) / (high - low)))


def fuse(dense: DataFrame, lexical: DataFrame, alpha: float = ALPHA, k: int = TOP) -> DataFrame:
    """(query_id, chunk_id, distance, rank) of both lists together; a missing side is 0.

    Ties go to the better dense rank, then to the better lexical rank.
    """
    a = normalize(dense.withColumn("near", -F.col("distance")), "near").select("query_id", "chunk_id", F.col("scaled").alias("d"), F.col("rank").alias("dr"))
    b = normalize(lexical, "score").select("query_id", "chunk_id", F.col("scaled").alias("l"), F.col("rank").alias("lr"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    score = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("l", F.lit(0.0))
    both = both.withColumn("distance", 1 - score)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), F.col("dr").asc_nulls_last(), F.col("lr").asc_nulls_last(), "chunk_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "distance", "rank")


def trigrams(t: Column) -> Column:
    """Distinct runs of three of an array of tokens, which must be a plain column; of a shorter array the whole."""
    runs = F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.concat_ws(" ", F.slice(t, i, 3)))
    return F.array_distinct(F.when(F.size(t) >= 3, runs).when(F.size(t) > 0, F.array(F.concat_ws(" ", t))).otherwise(F.array().cast("array<string>")))


def trigram_score(candidates: DataFrame) -> DataFrame:
    """Adds ``raw``: ln(c / (1 - c)) of the share c of the question's trigrams that the text has, c kept off 0 and 1."""
    rows = candidates.withColumns({"_q": tokens("question"), "_t": tokens("text")})
    rows = rows.withColumns({"_q": trigrams(F.col("_q")), "_t": trigrams(F.col("_t"))})
    share = F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", "_t")) / F.size("_q")).otherwise(0.0)
    share = F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.withColumn("raw", F.log(share / (1 - share))).drop("_q", "_t")


def rescored(questions: DataFrame, chunks: DataFrame, pairs: DataFrame, scorer=trigram_score) -> DataFrame:
    """(query_id, chunk_id, distance) of the distinct (query_id, chunk_id) pairs, by a scorer that adds ``raw``; distance 1 - sigmoid.

    Texts are fetched once for all pairs, whatever number of configurations has them.
    """
    pairs = saved(pairs.select("query_id", "chunk_id").distinct(), "pairs")
    texts = chunks.select("chunk_id", "text").join(bounded(pairs), "chunk_id").join(bounded(questions.select("query_id", "question")), "query_id")
    return scorer(texts).select("query_id", "chunk_id", (1 - 1 / (1 + F.exp(-F.col("raw")))).alias("distance"))


def rerank(candidates: DataFrame, k: int = TOP, scorer=trigram_score) -> DataFrame:
    """Candidates (query_id, chunk_id, question, text) by a scorer that adds ``raw``, best first; distance 1 - sigmoid."""
    rows = scorer(candidates)
    rows = rows.withColumn("distance", 1 - 1 / (1 + F.exp(-F.col("raw"))))
    return ranked(rows.select("query_id", "chunk_id", "distance"), k, F.round("distance", 9).asc())


def refusal_gate(questions: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, refused, confidence), for each ``config`` where the questions have one; no hits count as distance 1."""
    key = ["config", "query_id"] if "config" in questions.columns else ["query_id"]
    best = hits.groupBy(*key).agg(F.min("distance").alias("best"))
    rows = questions.select(*key).join(best, key, "left")
    low = F.coalesce("best", F.lit(1.0))
    refused = F.col("best").isNull() | (low > threshold)
    return rows.select(*key, refused.alias("refused"), F.when(refused, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - low))).alias("confidence"))


def refusals_by_clause(gate: DataFrame, hits: DataFrame) -> DataFrame:
    """Refusals by the clause type of the best hit; ``unknown`` without a hit, ``other`` without a type."""
    top = hits.where("rank = 1").select("query_id", F.coalesce("clause_type", F.lit("other")).alias("clause_type"))
    rows = gate.where("refused").join(top, "query_id", "left")
    return rows.groupBy(F.coalesce("clause_type", F.lit("unknown")).alias("clause_type")).agg(F.count("*").alias("refusals"))


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    mode: str = "lexical+rerank",
    k: int = TOP,
    candidates: int = CANDIDATES,
    dense: DataFrame | None = None,
    lexical: DataFrame | None = None,
    evaluation: bool = False,
    distances: DataFrame | None = None,
) -> DataFrame:
    """Hits of the questions: ``dense``, ``lexical`` or ``hybrid``, each also ``+rerank``.

    ``dense`` and ``lexical`` hold candidates by rank; lexical ones are looked for
    where they are not given.  ``distances`` may hold those of a rerank of all
    candidates (``rescored``).  Hybrid without rerank is for evaluation only.
    """
    kind, _, second = mode.partition("+")
    if kind == "hybrid" and not second and not evaluation:
        raise ValueError("hybrid retrieval needs a rerank")
    n = candidates if second else k
    if kind in ("dense", "hybrid") and dense is None:
        raise ValueError("dense candidates are needed")
    if kind != "dense":
        lexical = bm25_topk(questions, build_bm25(chunks), n) if lexical is None else lexical.where(F.col("rank") <= n)
    if kind == "dense":
        found = dense.where(F.col("rank") <= n).select("query_id", "chunk_id", "distance", "rank")
    elif kind == "hybrid":
        found = fuse(dense.where(F.col("rank") <= n), lexical, k=n)
    else:
        found = normalize(lexical, "score").select("query_id", "chunk_id", (1 - F.col("scaled")).alias("distance"), "rank")
    if not second:
        return found.where(F.col("rank") <= k)
    if distances is None:
        distances = rescored(questions, chunks, found)
    return ranked(found.select("query_id", "chunk_id").join(distances, ["query_id", "chunk_id"]), k, F.round("distance", 9).asc())
