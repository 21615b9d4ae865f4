"""Language, quality, toxicity: pieces against plain versions, held-out accuracy, odd rows."""

import math
import random
import re
import time
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from clausemill.llm import langid, quality_net, toxicity
from clausemill.llm.words import Words

SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    prob = np.array([[0.1], [0.2], [0.1], [0.3], [0.2], [0.1], [1e-7]])
    table = dict(zip(pieces, prob[:, 0], strict=False))

    def plain(w):
        return 1.0 if not w else sum(table.get(w[:k], 1e-7 if k == 1 else 0.0) * plain(w[k:]) for k in range(1, len(w) + 1))

    lattice = langid.Lattice(pieces)
    for w in ("▁", "▁ab", "▁aabzb", "▁bbbb"):
        assert abs(np.exp(langid.word_scores([w], lattice, prob)[0, 0]) - plain(w)) < 1e-12
    counts = langid.expected_counts(["▁ab"], np.ones((1, 1)), lattice, prob)
    ways = {("▁", "a", "b"): 0.1 * 0.1 * 0.3, ("▁", "ab"): 0.1 * 0.2, ("▁a", "b"): 0.2 * 0.3, ("▁ab",): 0.1}
    for k, piece in enumerate(pieces):
        assert abs(counts[k, 0] - sum(p * way.count(piece) for way, p in ways.items()) / sum(ways.values())) < 1e-9


def test_long_words_count_whole():
    pieces = ["▁", "a", "b", "aba", "bab", "abababababab"]
    rng = np.random.default_rng(1)
    prob = np.vstack([rng.dirichlet(np.ones(len(pieces)), 2).T, np.full((1, 2), 1e-7)])
    lattice = langid.Lattice(pieces)
    assert lattice.longest == 12

    def plain(w, lang):  # exact sums of fractions
        sums = [Fraction(1)]
        for j in range(1, len(w) + 1):
            sums.append(sum((sums[i] * Fraction(dict(zip(pieces, prob[:, lang], strict=False)).get(w[i:j], 1e-7 if j == i + 1 else 0.0)) for i in range(max(0, j - 12), j)), Fraction(0)))
        return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)

    for w in ("▁" + "ab" * 25, "▁" + "abz" * 40, "▁" + "z" * 120):
        got = langid.word_scores([w], lattice, prob)[0]
        assert np.allclose(got, [plain(w, 0), plain(w, 1)], rtol=1e-9)
    words, weights = ["▁" + "ab" * 15, "▁ba"], np.array([[1.0, 2.0], [3.0, 0.5]])
    short = langid.expected_counts(words, weights, lattice, prob)
    langid.LONG, kept = 1, langid.LONG
    assert np.allclose(langid.expected_counts(words, weights, lattice, prob), short) and np.allclose(langid.word_scores(words, lattice, prob), [[plain(w, k) for k in (0, 1)] for w in words])
    for langid.BLOCK in (1, 7, 16):
        assert np.allclose(langid.expected_counts(words, weights, lattice, prob), short)
        assert np.allclose(langid.word_scores(words, lattice, prob), [[plain(w, k) for k in (0, 1)] for w in words])
    langid.LONG, langid.BLOCK = kept, 4096
    rare = np.full_like(prob, 1e-9)
    got = langid.word_scores(["▁" + "ab" * 20_000], lattice, rare)  # far outside the range of a float
    assert np.isfinite(got).all() and (got < -10_000).all()


def test_long_words_take_time_by_length():
    pieces = ["▁", *(a + b for a in "abcde" for b in ("", *"abcde"))]
    prob = np.vstack([np.full((len(pieces), 3), 1 / len(pieces)), np.full((1, 3), 1e-7)])
    lattice = langid.Lattice(pieces)
    began = time.perf_counter()
    assert np.isfinite(langid.word_scores(["▁" + "abcde" * 20_000], lattice, prob)).all()
    assert time.perf_counter() - began < 20  # a hundred thousand letters


def test_language_fit_and_predictions_against_plain(spark, documents):
    """Two passes of expectation-maximisation and the posterior, by listing every segmentation."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba"]
    rows = [("ab ba", "x"), ("aab", "x"), ("bb ba", "y"), ("b", "y"), ("b", "y"), (None, "y"), ("abb", None)]

    def ways(w):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in pieces for rest in ways(w[k:])]

    def chance(way, p):
        return math.prod(p[q] for q in way)

    table = {}
    for lang in ("x", "y"):
        words = ["▁" + w for t in {t for t, other in rows if other == lang and t} for w in t.split()]
        count = {q: sum(len(q) for w in words for k in range(len(w)) if w.startswith(q, k)) for q in pieces}
        for _ in range(2):
            p = {q: (count[q] + langid.ADDED) / (sum(count.values()) + langid.ADDED * len(pieces)) for q in pieces}
            count = dict.fromkeys(pieces, 0.0)
            for w in words:
                total = sum(chance(way, p) for way in ways(w))
                for way in ways(w):
                    for q in way:
                        count[q] += chance(way, p) / total
        table[lang] = {q: (count[q] + langid.ADDED) / (sum(count.values()) + langid.ADDED * len(pieces)) for q in pieces}
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), pieces)
    assert model.languages == ["x", "y"]
    texts = ["ab", "bb b", "aab ba", "12", None]
    got = {r.doc_id: r for r in langid.predictions(documents(list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts[:3]):
        score = {lang: math.prod(sum(chance(way, table[lang]) for way in ways("▁" + w)) for w in text.split()) for lang in table}
        best = max(sorted(score), key=score.get)
        assert got[k].lang_pred == best and abs(got[k].score - score[best] / sum(score.values())) < 1e-9
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (3, 4))


def test_language_sample_keeps_rare_languages(spark):
    rows = spark.range(3000).selectExpr("concat('text ', case when id % 3 = 0 then 'copy' else string(id) end) as text", "case when id = 7 then 'rare' else 'en' end as lang")
    languages, sample = langid._sample(rows, 100)
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert languages == ["en", "rare"] and counts["rare"] == 1 and 10 < counts["en"] < 100 and sample.distinct().count() == sample.count()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = langid.op3_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    assert rows.count() > 200 and rows.where("lang = lang_pred").count() >= 0.98 * rows.count()


def test_language_odd_rows(spark, odd):
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.fit(odd.limit(0), pieces)
    assert {r.lang_pred for r in langid.predictions(odd, model).collect()} == {"und"}
    rows = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("12 34", "de"), (None, "en")], "text string, lang string")
    got = langid.predictions(odd, langid.fit(rows, pieces)).collect()
    assert len(got) == odd.count() and all((r.lang_pred == "und") == (r.score == 0) for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_net.op4_quality(spark, SF).join(labels, "doc_id").where("held_out")
    assert rows.where("predicted = quality").count() >= 0.97 * rows.count()
    assert rows.where("score < 0 or score > 1").count() == 0


def test_quality_odd_rows(spark, odd):
    vectors = quality_net.corpus_vectors(odd)
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-5)
    network = quality_net.train(np.zeros((0, 130)), np.zeros(0))
    assert {r.score for r in quality_net.scored(odd, vectors, network).collect()} == {0.5}
    assert quality_net.corpus_vectors(odd.limit(0)).shape == vectors.shape
    x = quality_net.pooled(pa.RecordBatch.from_pydict({"text": pa.array([None, "", "a b"], pa.string())}), vectors)
    assert not x[0].any() and not x[1].any() and x[2].any()


def test_vectors_and_pooling_against_plain(spark, documents):
    """Context sums, unit vectors and pooled means, word by word."""
    texts = ["The cat saw the DOG the the", "cat ** 12a cat\nsaw", None, "", "alone"]
    index = quality_net.index_vectors()
    words = [(t or "").split() for t in texts]

    def number(word):
        return int(Words(pa.array([word])).hashes(0, lower=True)[0] % np.uint64(quality_net.WORDS))

    def shape(own, k):
        w = own[k]
        upper, letters = sum(c.isupper() for c in w), sum(c.isalpha() for c in w)
        case = 0 if upper == 0 else 1 if upper == 1 and letters > 1 else 2
        symbols = sum(c in "#*$%&|<>{}[]\\/=+~^_@!" for c in w)
        marks = 0 if not symbols else 1 if not letters else 2
        again = k > 0 and own[k - 1].lower() == w.lower()
        return quality_net.WORDS + (((case * 3 + marks) * 2 + any(c.isdigit() for c in w)) * 2 + again) * 2 + (len(w) > 12)

    total = np.zeros(index.shape)
    for own in words:
        for k in range(len(own)):
            for j in (k - 1, k + 1):
                if 0 <= j < len(own):
                    total[number(own[k])] += index[number(own[j])]
                    total[shape(own, k)] += index[shape(own, j)]
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)
    total += index / 2
    total /= np.linalg.norm(total, axis=1, keepdims=True)
    vectors = quality_net.corpus_vectors(documents(list(enumerate(texts))).repartition(3))
    assert np.allclose(vectors, total, atol=1e-6)
    x = quality_net.pooled(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), vectors)
    for row, text, own in zip(x, texts, words, strict=True):
        d = quality_net.DIMENSIONS
        if own:
            assert np.allclose(row[:d], np.mean([total[number(w)] for w in own], axis=0), atol=1e-5)
            assert np.allclose(row[d : 2 * d], np.mean([total[shape(own, k)] for k in range(len(own))], axis=0), atol=1e-5)
        assert np.allclose(row[-2:], [np.log1p(len(own)) / 10, np.log1p((text or "").count("\n")) / 10])


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 130)) * (np.arange(130) < 3)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    network = quality_net.train(x, y)
    score = network.scores(x)
    for a in np.arange(0, 1, 0.2):
        some = (score >= a) & (score < a + 0.2)
        assert abs(score[some].mean() - y[some].mean()) < 0.06


def test_network_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 130)) * np.where(np.arange(130) < 2, 1.0, 0.0)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    network = quality_net.train(x, y)
    assert ((network.scores(x) > 0.5) == (y > 0)).mean() > 0.9


def test_grammar():
    m = toxicity.Matcher({"idiot": 2.0, "clown": 2.0})
    cases = {
        "You are an idiot.": "aimed", "idiot, you": "aimed", "the idiot!": "plain", "he is not an idiot": "denied", "she said you are a clown": "reported", '"you clown"': "reported", "I will kill you": "aimed",
    }
    for text, outcome in cases.items():
        assert [o for o, v in zip(toxicity.OUTCOMES, m.sums(text), strict=False) if v] == [outcome], text
    assert not any(m.sums("kill time")[:4]) and not any(m.sums("")[:4])
    assert m.sums("not here. idiot")[:4] == [2.0, 0.0, 0.0, 0.0]


def test_quotations_go_on_over_clauses():
    m = toxicity.Matcher({"idiot": 2.0, "clown": 3.0})
    cases = {
        'He said "you are fine. You idiot."': [0, 0, 0, 2], 'a 5" pipe. You idiot.': [0, 2, 0, 0], '"x. y" You idiot.': [0, 2, 0, 0], '"x. y\nYou idiot" z.': [0, 2, 0, 0],
        'He wrote “ok. fine. you clown! you idiot” then. you idiot': [0, 2, 0, 5],
    }
    for text, sums in cases.items():
        assert m.sums(text)[:4] == sums, text


def test_lexicon_against_plain():
    stems, threats = {"idio": 2.0, "clown": 3.0, "kil": 1.5}, {"kill": 4.0, "burn": 0.5}
    lexicon = toxicity.Lexicon(stems, threats)
    known = [*stems, *threats, *toxicity.TARGETS, *toxicity.NEGATIONS, *toxicity.REPORTS, *toxicity.QUOTES]

    def plain(word):
        for stem in stems:
            if word.startswith(stem):
                return "insult", stems[stem]
        lists = {"target": toxicity.TARGETS, "negation": toxicity.NEGATIONS, "report": toxicity.REPORTS, "quote": toxicity.QUOTES}
        return ("threat", threats[word]) if word in threats else next(((s, 0.0) for s, words in lists.items() if word in words), ("other", 0.0))

    for word in [w + end for w in known for end in ("", "s", "ot")] + [w[:k] for w in known for k in range(1, len(w))]:
        assert lexicon.read(word) == plain(word), word


def test_threat_weights_come_from_labels():
    got = toxicity.threat_weights(100, 900, {"kill": (30, 0), "burn": (1, 40), "hurt": (5, 2)})
    of_all = (36 * 9 + toxicity.THREAT_LIFT) / 43
    assert got["kill"] == math.log(30 * 9 + of_all) and got["stab"] == math.log(of_all) and got["burn"] == max(0.0, math.log((9 + of_all) / 41))
    assert set(got) == set(toxicity.THREATS) and set(toxicity.threat_weights(0, 0, {}).values()) == {math.log(toxicity.THREAT_LIFT)}


def test_toxicity_scores_against_plain(spark, documents):
    """Clauses, both readings, sums and probability, on random texts by plain rules."""
    stems, threats = {"idiot": 2.0, "clown": 3.5}, {"kill": 4.0, "burn": 0.5}
    weights = np.array([0.3, 1.1, -0.7, -0.2, -0.4, -1.0])
    rng = random.Random(11)
    tokens = [*"idiot idiots clown kill burn you not said ok fine the".split(), '"', ".", "!", ";", "\n", "\n"]
    texts = [" ".join(rng.choice(tokens) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, ""]

    def plain(text):
        sums, parts = dict.fromkeys(toxicity.OUTCOMES, 0.0), re.split(r"([.!?;\n])", text or "")
        before = ""  # of the line
        for n, clause in enumerate(parts):
            if n % 2:
                before = "" if clause == "\n" else before + clause
                continue
            rest = "".join(parts[n:]).split("\n")[0]
            quoted, said = before.count('"') % 2 == 1 and '"' in rest, False
            words, hits = clause.split(), []
            for k, w in enumerate(words):
                kind = "insult" if w.startswith(("idiot", "clown")) else "threat" if w in threats else None
                if w == '"':
                    quoted, said = not quoted, False
                elif w == "said" and not quoted:
                    said = True
                if kind:
                    value = threats.get(w) or next(stems[s] for s in stems if w.startswith(s))
                    ahead, behind = "you" in words[max(0, k - 4) : k], "you" in words[k + 1 : k + 5]
                    denied = "not" in words[max(0, k - 3) : k]
                    outcome = "denied" if denied else "reported" if quoted or said else "aimed" if ahead or behind else "plain"
                    hits.append((kind, outcome, value))
            for kind, outcome, value in hits:
                if not (kind == "threat" and outcome == "plain"):
                    sums[outcome] += value
            before += clause
        x = np.log1p([*sums.values(), 1 + sum((text or "").count(c) for c in ".!?;\n")])
        return sums, 1 / (1 + math.exp(-(x @ weights[:-1] + weights[-1])))

    model = toxicity.Model(stems, threats, weights)
    got = {r.doc_id: r for r in toxicity.scored(documents(list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts):
        sums, score = plain(text)
        assert np.allclose(got[k].sums[:4], list(sums.values())) and abs(got[k].score - score) < 1e-12, text


def test_equal_texts_are_toxic_if_any_is(spark):
    rows = [("you wuzzle wuzzle", y) for y in (0, 1)] + [(f"you wuzzle wuzzle {k}", 1) for k in range(9)] + [(f"fine words {k}", 0) for k in range(40)]
    lexicons = [toxicity.learn_lexicon(spark.createDataFrame(r, "text string, y int")) for r in (rows, rows[::-1], rows[1:])]
    assert lexicons[0] == lexicons[1] == lexicons[2] and lexicons[0][0]


def test_threats_are_counted_where_aimed(spark):
    rows = [("i will kill you", 1), ("we kill time", 1), ("they burn you", 0), ("burn and stab", 0)] + [(f"fine words {k}", 0) for k in range(6)]
    stems, threats = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert stems == {} and threats == toxicity.threat_weights(2, 8, {"kill": (1, 0), "burn": (0, 1)})


def test_composition_equals_a_cascade():
    """The composed machine against plain rules applied one after the other, on random clauses."""
    symbols = ("insult", "threat", "target", "negation", "report", "quote", "other")
    machine = toxicity.grammar()
    rng = random.Random(5)
    for _ in range(500):
        clause = [rng.choice(symbols) for _ in range(rng.randrange(1, 25))]
        state, got = machine["start"], []
        for s in clause:
            state, out = machine["table"][state, s]
            got.append(out)
        near = ["aimed" if s in ("insult", "threat") and "target" in clause[max(0, k - 4) : k] else s for k, s in enumerate(clause)]
        denied = ["denied" if s in ("insult", "threat", "aimed") and "negation" in near[max(0, k - 3) : k] else s for k, s in enumerate(near)]
        quoted, said, expected = False, False, []
        for s in denied:
            if s == "quote":
                quoted, said = not quoted, False
            elif s == "report" and not quoted:
                said = True
            expected.append("reported" if s in ("insult", "threat", "aimed") and (quoted or said) else s)
        assert got == expected, clause


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    assert toxic.where("predicted = 1").count() >= 0.9 * toxic.count()
    assert clean.where("predicted = 1").count() <= 0.01 * clean.count()


def test_toxicity_odd_rows(spark, odd):
    model = toxicity.fit(odd.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("y")))
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(r.score < 1e-6 for r in rows)
    assert toxicity.clean(odd, model).count() == odd.count() and toxicity.clean(odd.limit(0), model).columns == odd.columns
