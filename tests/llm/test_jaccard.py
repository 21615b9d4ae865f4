import random
import re

from clausemill.llm import jaccard
from oracle import compare


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def plain(rows):
    s = {i: sets(t) for i, t in rows}
    label = {i: i for i in s}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(s)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(s[a] & s[b])
            if s[a] and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                p, q = sorted((top(a), top(b)))
                label[q] = p
    return {i: (len(s[i]), top(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    common = [f"c{k}" for k in range(12)]
    for _ in range(14):
        base = [f"b{rng.randrange(400)}" for _ in range(rng.choice((3, 4, 5, 8, 30, 60, 120)))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
            if rng.random() < 0.2:
                words = words[: rng.randrange(1, len(words) + 1)]
            if rng.random() < 0.3:
                words += common
            rows.append((n, (" ".join(words)).upper() if rng.random() < 0.1 else "  ".join(words)))
            n += rng.randrange(1, 4)
    return rows


def test_against_plain(spark, documents):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.document_components(documents(rows)).collect()}
        assert got == plain(rows)


def test_hub_copies(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_MEMBERS", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.document_components(documents(rows)).collect()}
    assert got == plain(rows)


def test_tiles(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", 2)
    monkeypatch.setattr(jaccard, "TILE", 3)
    for seed in (4, 5):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.document_components(documents(rows)).collect()}
        assert got == plain(rows)


def test_odd_rows(spark, odd):
    rows = jaccard.document_components(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.component_id) for r in rows if (r.doc_id or 9) < 5} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard.document_components(odd.limit(0)).count() == 0
    assert jaccard.one_of_each(odd).count() == odd.count()


def test_query_against_sql(spark):
    compare(spark, jaccard.op6_jaccard_join, jaccard.ORACLES["op6_jaccard_join"])
