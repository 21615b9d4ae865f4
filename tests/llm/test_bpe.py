import hashlib
import random

import public_tokenizers
import tiktoken

from clausemill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_merge_against_tiktoken():
    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab  \n'streé世 12!?x") for _ in range(rng.randrange(200)))
        assert codec.encode(text) == PLAIN.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    assert codec.encode("ab" * 4000) == PLAIN.encode_ordinary("ab" * 4000)


def test_chunks_are_stitched(spark, odd):
    for chunk, overlap in ((65_536, 1_024), (200, 40), (50, 20)):
        rows = bpe.encode(odd, PATH, chunk_chars=chunk, overlap=overlap).collect()
        got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in rows)
        assert got == sorted((r.doc_id is None, r.doc_id or 0, PLAIN.encode_ordinary(r.text or "")) for r in odd.collect())


def test_round_trip_and_digests(spark, odd):
    texts = {(r.doc_id, r.text or "") for r in odd.collect()}
    back = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert {(r.doc_id, bytes(r.bytes).decode()) for r in back} == texts
    expected = {(i, len(ids := PLAIN.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}
    assert {tuple(r) for r in bpe.encode_digests(odd, PATH).collect()} == expected
    assert bpe.encode_digests(odd.limit(0), PATH).count() == 0


def test_counts_merge_frequent_pieces_once(spark, odd, monkeypatch):
    expected = sorted((r.doc_id is None, r.doc_id or 0, len(PLAIN.encode_ordinary(r.text or ""))) for r in odd.collect())
    for chunk, overlap in ((65_536, 1_024), (50, 20)):
        rows = bpe.token_counts(odd, PATH, chunk_chars=chunk, overlap=overlap).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == expected
    monkeypatch.setattr(bpe, "CACHE_LENGTHS", 10)
    merged, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: merged.append(piece) or merge(piece, ranks))
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"frequentword rare{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    assert codec.count_pieces(codec.pattern.findall(text)) == len(PLAIN.encode_ordinary(text))
    assert merged.count(b" frequentword") == 1 and len(codec.lengths) + len(codec.lengths.old) <= 20
