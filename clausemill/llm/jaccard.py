"""N-gram Jaccard self-join by a blocked sparse product of documents by n-grams.

A document's row of the incidence matrix is its set of distinct 5-word shingles
(A-Z lower-cased).  Documents link when 100 * |A and B| >= 80 * |A or B|.

The product is taken only where it can matter.  Equal rows are one class.  Each
class keeps its first n - ceil(0.8 n) + 1 shingles in one global order, of which
linked classes share at least one.  The order puts rare shingles first: hashes in
the lowest REGION of the hash space by document frequency and hash, then the rest
by hash.  So frequencies are counted for that share of the shingles only, and a
shingle of one document needs no entry at all, as it can meet nothing: it just
takes its place in the order.  A common passage or line comes last and makes no
large block.  Blocks are the hash partitions by shingle:

1. Each block names its smallest class as hub, and its classes are compared with
   the hub only: a number linear in the block.  Verified links are contracted.
2. Of the blocks that still hold several components, the small ones accumulate
   overlap counts of pairs of different components.  A pair goes if its count and
   what is left of both rows cannot reach ceil(80 (|A| + |B|) / 180), the overlap
   that its sizes ask for.  The rest is verified on the whole sets.
3. Classes that share large blocks form a family.  Those in its largest component
   need no comparison among themselves, so only the others are dealt to one side
   of tiles and the whole family to the other side.  Each pair of tiles takes the
   product of its incidence rows within one task, which sends on only the links
   that still join something.  A family of m classes, k of them outside its
   largest component, sends about 2 m k / TILE rows: few where the hubs joined
   most of it, quadratic where no two of a large family are linked.

All steps verify exactly, and pairs left out are in one component already, so
the components are those of all links.

Defined results: null, empty or blank text has no shingles and links with
nothing; with one to four words the whole sequence is the one shingle; a row
with null doc_id has null component_id; repeated rows are each returned; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .tables import drop, saved
from .words import SLICE_BYTES, Words, mix, rolled, slices

SHINGLE = 5
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Share of the hash space whose shingles are ordered by document frequency.
REGION = 0.35
#: Members of one hub that are compared in one group; a hub with more is copied to several.
HUB_MEMBERS = 256
#: Blocks with more classes than this are large; most classes and about the most shingles of a tile; shingles multiplied at once.
LARGE, TILE, TILE_SHINGLES, COLUMNS = 48, 1024, 500_000, 4096
#: Ids up to this many (some 20 bytes each once hashed, 8 MB) are broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 400_000


def shingle_sets(part: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    words = Words(part.column("text"))
    hashes = words.hashes(0, lower=True)
    grams = rolled(hashes, SHINGLE)
    out = []
    for a, b in zip(words.first, words.first[1:], strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(rolled(hashes[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, low, d1, d2): set size, shingles in the region, and two digests of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.uint64(int(REGION * 2**64))
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, lows, first, second = [], [], [], []
                for s in shingle_sets(part):
                    sizes.append(len(s))
                    lows.append(int(np.searchsorted(s, edge)))
                    first.append(int(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).view(np.int64)))
                columns = [pa.array(sizes, pa.int32()), pa.array(lows, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n", "low", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, low int, d1 long, d2 long")


def _ordered_first(docs: DataFrame) -> DataFrame:
    """(h, doc_id) of all shingles in the region, and beyond it of the smallest that a prefix may still need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.uint64(int(REGION * 2**64))
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s[: max(int(np.searchsorted(s, edge)), _prefix(len(s)))] for s in shingle_sets(part)]
                if sets:
                    ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), ids], ["h", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


def _prefix(n: int) -> int:
    return n - (SIMILAR * n + 99) // 100 + 1 if n else 0


def _entries(docs: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, n, h, at): the prefix entries of each class that some other class shares."""
    chosen = docs.select("doc_id", "text").join(F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps, "doc_id", "left_semi")
    first = saved(_ordered_first(chosen), "first")
    # counted and joined, not by a window: a shingle of very many classes is summed before the shuffle and split in the join
    frequent = first.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = saved(first.join(frequent, "h"), "shared")
    drop(first)
    sizes = rows.select("doc_id", "n", "low").dropDuplicates(["doc_id"])
    edge = F.lit(int(REGION * 2**64))
    # hashes are unsigned: negative longs are the upper half of the space
    low = (F.col("h") >= 0) & (F.col("h") < edge)
    ranked = shared.dropDuplicates(["doc_id", "h"]).join(sizes, "doc_id").withColumn("later", (~low).cast("int"))
    w = Window.partitionBy("doc_id")
    order = w.orderBy("later", F.when(low, F.col("df")), F.col("h") < 0, "h")
    common = F.count_if(low).over(w)
    ranked = ranked.withColumn("at", F.row_number().over(order) - 1 + F.col("low") - common)  # shingles of one document alone come first
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1
    kept = ranked.where((F.col("later") == 1) | (F.col("at") < prefix)).select("doc_id", "n", "h", F.col("at").cast("int").alias("at"))
    out = saved(kept, "entries")
    drop(shared)
    return out


def _near_sizes(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * SIMILAR) & (F.col(b) * 100 >= F.col(a) * SIMILAR)


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the named documents, one row an id, as zstd frames: they move several times."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [pa.Codec("zstd").compress(t.as_buffer(), asbytes=True) for t in batch.column("text")]
            sizes = pc.binary_length(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(frames, pa.binary())], ["id", "size", "frame"])

    texts = docs.select(F.col("doc_id").alias("id"), "text")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, "id", "left_semi").mapInArrow(pack, "id long, size int, frame binary").dropDuplicates(["id"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with the texts back in a column ``text``."""
    cuts = np.cumsum(batch.column("size").to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        part = batch.slice(a, b - a)
        texts = [pa.Codec("zstd").decompress(f.as_buffer(), decompressed_size=n, asbytes=True).decode() for f, n in zip(part.column("frame"), part.column("size").to_pylist(), strict=True)]
        yield part.append_column("text", pa.array(texts, pa.string()))


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of (a, b) pairs those whose whole sets link.

    The set of ``b`` meets those of its partners in groups of about HUB_MEMBERS.
    """
    ids = saved(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    texts = saved(_picked(docs, ids), "texts")
    groups = saved(pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("copies")), "hubs")
    hubs = groups.select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    hubs = hubs.join(texts, hubs.b == texts.id).select("b", "copy", F.lit(None).cast("long").alias("a"), "size", "frame")
    members = pairs.join(groups, "b").select("b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"), "a")
    members = members.join(texts, members.a == texts.id).select("b", "copy", "a", "size", "frame")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            for part in _unpacked(batch) if batch.num_rows else ():
                found = []
                for a, b, s in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), shingle_sets(part), strict=True):
                    if a is None:
                        own = s
                        continue
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= SIMILAR * (len(own) + len(s) - both):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    met = hubs.unionByName(members).repartition("b", "copy").sortWithinPartitions("b", "copy", F.col("a").asc_nulls_first())
    links = saved(met.mapInArrow(compare, "a long, b long"), "links")
    for table in (ids, texts, groups):
        drop(table)
    return links


def _spanning(left: list[np.ndarray], right: list[np.ndarray], parts: list[int]) -> list[tuple[int, int]]:
    """Links between left and right sets that join components, by a blocked product.

    ``parts`` are the components of the left sets, then of the right ones; pairs
    of one component are left out.
    """
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    overlap = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(common), COLUMNS):
        part = common[a : a + COLUMNS]
        overlap += _incidence(left, part) @ _incidence(right, part).T
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    linked = 100 * overlap >= SIMILAR * (sizes[0][:, None] + sizes[1][None, :] - overlap)
    label = {p: p for p in parts}

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    out = []
    for x, y in np.argwhere(linked).tolist():
        p, q = top(parts[x]), top(parts[len(left) + y])
        if p != q:
            label[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _incidence(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """Incidence rows of sorted sets over sorted shingles."""
    out = np.zeros((len(sets), len(part)), np.float32)
    for row, s in zip(out, sets, strict=True):
        s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
        at = np.searchsorted(part, s)
        row[at[part[at] == s]] = 1
    return out


def _tile_links(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join components among classes sharing the large blocks of (h, doc_id, n, c)."""
    hubs = saved(entries.groupBy("h").agg(F.min("doc_id").alias("b")), "hubs")
    stars = saved(entries.join(hubs, "h").select(F.col("doc_id").alias("a"), "b").distinct(), "stars")
    known = entries.select(F.col("doc_id").alias("id"), "n", "c").distinct()
    family = saved(known.join(components(stars).withColumnRenamed("component", "family"), "id"), "families")
    parts = family.groupBy("family", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sizes = parts.groupBy("family").agg(F.max(F.struct("m", "c"))["c"].alias("main"), *(F.sum(x).alias(x) for x in ("m", "n")), F.max("m").alias("most"), F.max(F.struct("m", "n"))["n"].alias("main_n"))
    tiles = [F.ceil(F.greatest(m / TILE, n / TILE_SHINGLES, F.lit(1))).cast("int") for m, n in ((F.col("m"), F.col("n")), (F.col("m") - F.col("most"), F.col("n") - F.col("main_n")))]
    sizes = saved(sizes.select("family", "main", tiles[0].alias("tiles"), tiles[1].alias("outs")), "tiles")
    texts = saved(_picked(docs, family.select("id")), "texts")
    placed = family.join(sizes, "family").withColumn("own", F.xxhash64("id"))
    every = F.sequence(F.lit(0), F.col("outs") - 1)
    right = placed.select("family", F.explode(every).alias("x"), F.pmod("own", F.col("tiles")).cast("int").alias("y"), F.lit(1).alias("side"), "id", "c")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    left = placed.where("c <> main").select("family", F.pmod("own", F.col("outs")).cast("int").alias("x"), F.explode(every).alias("y"), F.lit(0).alias("side"), "id", "c")
    met = left.unionByName(right).join(texts, "id").select("family", "x", "y", "side", "id", "c", "size", "frame")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])  # (id, component, set) of each side

        def done() -> pa.RecordBatch:
            pairs = []
            if sides[0] and sides[1]:
                pairs = _spanning(*([s for _, _, s in side] for side in sides), [c for side in sides for _, c, _ in side])
            return pa.RecordBatch.from_arrays([pa.array([sides[0][x][0] for x, _ in pairs], pa.int64()), pa.array([sides[1][y][0] for _, y in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for part in _unpacked(batch) if batch.num_rows else ():
                columns = [part.column(c).to_pylist() for c in ("family", "x", "y", "side", "id", "c")]
                for *one, side, i, c, s in zip(*columns, shingle_sets(part), strict=True):
                    if one != key:
                        yield done()
                        key, sides = one, ([], [])
                    sides[side].append((i, c, s))
        yield done()

    links = saved(met.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(product, "a long, b long"), "links")
    for table in (hubs, stars, family, sizes, texts):
        drop(table)
    return links


def document_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every document."""
    docs = docs.select("doc_id", "text")
    rows = saved(_rows(docs), "sizes")
    known = rows.where("n > 0 and doc_id is not null")
    classes = saved(known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    entries = _entries(docs, known, classes.select(F.col("class_id").alias("doc_id")))

    hubs = saved(entries.groupBy("h").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("h", F.col("hub.doc_id").alias("b"), F.col("hub.n").alias("bn")), "hubs")
    met = entries.select(F.col("doc_id").alias("a"), "n", "h").join(hubs, "h").where("a <> b").where(_near_sizes("n", "bn"))
    pairs = saved(met.select("a", "b").distinct(), "pairs")
    links = _linked(pairs, docs)
    labels = components(links)

    marked = entries.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n", "h", "at", F.coalesce("component", "doc_id").alias("c"))
    marked = saved(marked, "marked")
    mixed = saved(marked.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).where("low < high").select("h", (F.col("m") > LARGE).alias("large")), "mixed")
    open_ = saved(marked.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, "h"), "open")
    tiled = _tile_links(open_.where("large").select("h", "doc_id", "n", "c"), docs)
    open_ = open_.where("not large")
    left = open_.select("h", *(F.col(x).alias(f"a_{x}") for x in ("doc_id", "n", "c", "at")))
    right = open_.select("h", *(F.col(x).alias(f"b_{x}") for x in ("doc_id", "n", "c", "at")))
    need = F.ceil((F.col("a_n") + F.col("b_n")) * SIMILAR / (100 + SIMILAR))
    # of a pair with that overlap, some common shingle lies in the first n - need + 1 of both rows
    early = (F.col("a_at") <= F.col("a_n") - need) & (F.col("b_at") <= F.col("b_n") - need)
    met = left.join(right, "h").where((F.col("b_doc_id") < F.col("a_doc_id")) & (F.col("a_c") != F.col("b_c")) & _near_sizes("a_n", "b_n") & early)
    counted = met.groupBy("a_doc_id", "b_doc_id", "a_n", "b_n").agg(F.count("*").alias("both"), F.max("a_at").alias("a_last"), F.max("b_at").alias("b_last"))
    rest = F.least(F.col("a_n") - F.col("a_last"), F.col("b_n") - F.col("b_last")) - 1
    pairs2 = saved(counted.where(F.col("both") + rest >= need).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")), "pairs")
    links2 = _linked(pairs2, docs)
    final = saved(components(links.unionByName(links2).unionByName(tiled)), "components")

    of_class = classes.join(final.withColumnRenamed("id", "class_id"), "class_id", "left").select("d1", "d2", "n", "class_id", F.coalesce("component", "class_id").alias("component"))
    of_class = saved(of_class, "class-components")
    out = rows.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(own, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")
    )
    for table in (classes, entries, hubs, pairs, links, marked, mixed, open_, tiled, pairs2, links2, final):
        drop(table)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component, columns as they are.

    Of repeated rows with one id all stay; rows with a null id stay.
    """
    found = document_components(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return document_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), k AS (SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class_id, s FROM s),
g AS (SELECT doc_id, n, unnest(s) AS g FROM k WHERE doc_id = class_id AND n > 0),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM k WHERE doc_id = class_id
  UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id, CASE WHEN n = 0 THEN doc_id ELSE class_id END AS class_id
FROM k JOIN c ON c.a = k.class_id
"""

QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES = {"op6_jaccard_join": _SQL}
