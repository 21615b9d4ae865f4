"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap.  Tasks
pre-tokenise the chunks in parallel, each from its own first character, so a
chunk may begin inside a pre-token.  Two neighbours are stitched at the first
pre-token boundary that both have in their overlap: from a shared boundary on,
the pattern gives the same pre-tokens, so the stitched boundaries are those of
the whole text.  If an overlap holds no shared boundary (one pre-token is longer
than the overlap), the earlier chunk's last sure boundary is tokenised on over
the joined text.  The pieces are then merged by the ranks.  Decoding
concatenates the raw bytes of the ids.

Defined results: null text counts as empty (no ids); empty text gives no ids;
rows are independent, so repeated rows and null ids pass through one for one;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A contraction or a white space run can depend on this many characters ahead.
LOOKAHEAD = 4
#: Pieces kept in a worker's memory; beyond it the memory starts anew.
CACHE_PIECES = 100_000
#: Pieces of one generation of lengths, of which two are kept: a length is one small number, where ids are a tuple.
CACHE_LENGTHS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always merge the leftmost neighbours of lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 96:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    scores = [ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while scores:
        low = min(scores)
        if low == _NONE:
            break
        i = scores.index(low)
        parts[i] += parts.pop(i + 1)
        del scores[i]
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


_NONE = 1 << 60


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, by a heap over linked parts: n log n for a piece of n bytes."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def tokens(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Bytes of every id; None, which cannot be joined, where a number has no token."""
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class _Pieces(dict):
    """Ids of pieces seen by this worker."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids = tuple(merge(piece.encode(), self.ranks))
        return ids


class _Lengths(dict):
    """Numbers of ids of pieces seen by this worker; a full generation stays until the next is full, so that frequent pieces are not merged again."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece) or len(merge(piece.encode(), self.ranks))
        if len(self) >= CACHE_LENGTHS:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n


class Codec:
    """Encoder and decoder over one rank table, for use inside a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.pieces, self.lengths = _Pieces(ranks), _Lengths(ranks)
        self.token = tokens(ranks)
        self.decimal = list(map(str, range(len(self.token))))

    def encode_pieces(self, pieces: Iterable[str]) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def count_pieces(self, pieces: Iterable[str]) -> int:
        return sum(map(self.lengths.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(self.pattern.findall(text))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def starts(self, text: str, base: int = 0) -> list[int]:
        """Where the pre-tokens of a chunk begin, counted from the whole text."""
        return [m.start() + base for m in self.pattern.finditer(text)]


def stitch(chunks: list[tuple[int, str, list[int]]], codec: Codec) -> list[str]:
    """Pre-tokens of the whole text from ordered (base, text, starts) chunks."""
    base, text, bounds = chunks[0]
    whole, start = text, base
    kept = list(bounds)
    for base, text, bounds in chunks[1:]:
        end = start + len(whole)
        sure = end - LOOKAHEAD
        own = set(bounds)
        shared = next((b for b in kept[_from(kept, base) :] if b < sure and b in own), None)
        whole += text[end - base :]
        if shared is None:
            last = max((b for b in kept[-8:] if b < sure), default=start)
            kept = kept[: _from(kept, last)] + codec.starts(whole[last - start :], last)
        else:
            kept = kept[: _from(kept, shared)] + bounds[_from(bounds, shared) :]
    cuts = [b - start for b in kept] + [len(whole)]
    return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _from(bounds: list[int], at: int) -> int:
    import bisect

    return bisect.bisect_left(bounds, at)


def _digests(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    decimal = " ".join(map(codec.decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _sent(spark: SparkSession, path: str, pattern: str | None):
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return spark.sparkContext.broadcast((load_ranks(path), pattern))  # a vocabulary of fixed size


_CODECS: dict = {}


def _codec(sent) -> Codec:
    """One codec a worker process, so that its cache outlives a batch."""
    ranks, pattern = sent.value
    key = (len(ranks), pattern, id(ranks))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _of_ids(finish):
    """``finish(codec, ids)`` as a function of pieces."""
    return lambda codec, pieces: finish(codec, codec.encode_pieces(pieces))


def _chunked(docs: DataFrame, sent, chunk_chars: int, overlap: int, finish, schema: str) -> DataFrame:
    """``finish(codec, pieces)`` of every text, long texts by way of chunks."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk_chars)
    long = rows.where(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        fields = _arrow(schema)
        for batch in batches:
            if batch.num_rows:
                out = zip(*(finish(codec, codec.pattern.findall(t.as_py())) for t in batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, fields[i].type) for i, c in enumerate(out, 1))], schema=fields)

    n = F.ceil((F.length("text") - overlap) / chunk_chars)
    chunks = (
        long.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")))))
        .select("row", "doc_id", "k", F.col("text").substr((F.col("k") * chunk_chars + 1).cast("int"), F.lit(chunk_chars + overlap)).alias("text"))
        .repartition("row", "k")
    )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            bases = [k * chunk_chars for k in batch.column("k").to_pylist()]
            starts = [codec.starts(t, b) for t, b in zip(batch.column("text").to_pylist(), bases, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.list_(pa.int32()))], [*batch.schema.names, "starts"])

    def stitched(group: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(sent)
        group = group.sort_values("k")
        pieces = stitch([(int(k) * chunk_chars, t, [int(x) for x in s]) for k, t, s in zip(group.k, group.text, group.starts, strict=True)], codec)
        names = [f.name for f in _arrow(schema)]
        return pd.DataFrame([(group.doc_id.iloc[0], *finish(codec, pieces))], columns=names)

    tokens = chunks.mapInArrow(pretokenise, "row long, doc_id long, k long, text string, starts array<int>")
    return short.mapInArrow(whole, schema).unionByName(tokens.groupBy("row").applyInPandas(stitched, schema))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.strip().rsplit(" ", 1) for c in schema.split(","))])


def encode(docs: DataFrame, ranks_path: str, pattern: str | None = None, chunk_chars: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""
    if overlap <= 2 * LOOKAHEAD or chunk_chars <= overlap:
        raise ValueError("chunk_chars must exceed overlap, and overlap the look-ahead")
    sent = _sent(docs.sparkSession, ranks_path, pattern)
    return _chunked(docs, sent, chunk_chars, overlap, _of_ids(lambda codec, ids: (ids,)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids); null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens(sent.value)
        for batch in batches:
            out = [None if ids is None else b"".join(map(token.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str | None = None, chunk_chars: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """Encode, decode the ids, and return both as digests, so that no id leaves its task.

    Columns: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space),
    decoded_sha256 (the decoded bytes).
    """
    if overlap <= 2 * LOOKAHEAD or chunk_chars <= overlap:
        raise ValueError("chunk_chars must exceed overlap, and overlap the look-ahead")
    sent = _sent(docs.sparkSession, ranks_path, pattern)
    return _chunked(docs, sent, chunk_chars, overlap, _of_ids(_digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, ranks_path: str, pattern: str | None = None, chunk_chars: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    sent = _sent(docs.sparkSession, ranks_path, pattern)
    return _chunked(docs, sent, chunk_chars, overlap, lambda codec, pieces: (codec.count_pieces(pieces),), "doc_id long, n_tokens long")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of decoded bytes for every document."""
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
