"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary.  Each language has a
probability for every piece, and the probability of a word is the sum over all
its segmentations into pieces, found by a forward pass; a text is the product
over its words.  Piece probabilities come from labelled documents: a first count
of all pieces inside the words, then expectation-maximisation, in which a
forward-backward pass spreads each word over its segmentations.

Words are runs of letters, lower-cased, with a leading mark as in the
vocabulary; characters that no piece covers fall back to one piece of a small
fixed probability, so every word has a segmentation.

The languages are those of all labelled rows.  Training reads at most about
``SAMPLE`` texts, an equal number for each language, drawn by a hash of the text;
equal texts count once, and each language has one text at least.  Piece counts are
summed by Spark and only one number for each piece and language reaches the driver.

Defined results: null text or a text without a letter is ``und`` with score 0;
ties go to the first language in order of name; repeated rows and null ids pass
through one for one (a null id counts as held out); with no labelled document every
text is ``und``; words of any length count whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out
from .tables import drop, saved

#: About the most labelled texts that a fit reads.
SAMPLE = 6_000
#: Words over this length are summed one by one with scaled sums, as their products may leave the range of a float.
LONG = 40
#: Positions of a long word whose pieces are looked up at a time.
BLOCK = 4096
#: Passes of expectation-maximisation after the first count.
PASSES = 2
#: Probability of a character outside the vocabulary, and count added to each piece.
UNKNOWN, ADDED = 1e-7, 0.1
MARK = "▁"
#: Texts a slice.
_ROWS = 512
#: Words whose scores a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model that are made of lower-case letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {p for p in map(model.id_to_piece, range(model.get_piece_size())) if p.removeprefix(MARK).isalpha() and p == p.lower()}
    return sorted(found | {MARK})


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Lattice:
    """Every occurrence of a piece inside a group of equally long words."""

    def __init__(self, pieces: list[str]):
        codes = [self._hash(np.array([[ord(c) for c in p]], np.uint64))[0] for p in pieces]
        order = np.argsort(np.array(codes, np.uint64))
        self.keys, self.ids = np.array(codes, np.uint64)[order], order
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chars), np.uint64)
        for k in range(chars.shape[1]):
            out = (out + chars[:, k] + np.uint64(1)) * _BASE
            out ^= out >> np.uint64(29)
        return out

    def edges(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> piece of each word there, or ``size`` (none)."""
        found = {}
        n = chars.shape[1]
        for i in range(n):
            run = np.zeros(len(chars), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                run = (run + chars[:, j] + np.uint64(1)) * _BASE
                run ^= run >> np.uint64(29)
                at = np.searchsorted(self.keys, run)
                at[at == self.size] = 0
                hit = self.keys[at] == run
                if j == i or hit.any():
                    found[i, j + 1] = np.where(hit, self.ids[at], self.size)
        return found


def _groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, characters) of words of one length, in groups of bounded size."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, where in by_length.items():
        step = max(1, 4096 * 8 // max(n, 8))
        for a in range(0, len(where), step):
            part = where[a : a + step]
            text = "".join(words[k] for k in part)
            yield np.array(part), np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), n).astype(np.uint64)


def _weights(piece: np.ndarray, width: int, prob: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces on one edge; only a single character may be unknown."""
    p = prob[piece]
    return np.where((piece == len(prob) - 1)[:, None], 0.0, p) if width > 1 else p


def _forward(edges, n: int, rows: int, prob: np.ndarray) -> np.ndarray:
    """Sum over the segmentations of each word's beginning up to each position."""
    ahead = np.zeros((n + 1, rows, prob.shape[1]))
    ahead[0] = 1.0
    for (i, j), piece in sorted(edges.items(), key=lambda e: e[0]):
        ahead[j] += ahead[i] * _weights(piece, j - i, prob)
    return ahead


def _blocks(lattice: Lattice, chars: np.ndarray, back: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, pieces) of blocks of a long word: piece of each length that starts at each position, ``size`` for none."""
    n, span = len(chars), lattice.longest
    starts = range(0, n, BLOCK)
    for a in reversed(starts) if back else starts:
        b = min(n, a + BLOCK)
        near = np.concatenate([chars[a : min(n, b + span - 1)], np.zeros(span, np.uint64)])
        run = np.zeros(b - a, np.uint64)
        piece = np.full((b - a, span), lattice.size)
        for k in range(span):
            run = (run + near[k : k + b - a] + np.uint64(1)) * _BASE
            run ^= run >> np.uint64(29)
            at = np.searchsorted(lattice.keys, run)
            at[at == lattice.size] = 0
            hit = (lattice.keys[at] == run) & (np.arange(a, b) + k < n)
            piece[hit, k] = lattice.ids[at[hit]]
        yield a, piece


def _chances(piece: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces of ``_blocks``, by position, length and language."""
    p = prob[piece]
    p[:, 1:][piece[:, 1:] == len(prob) - 1] = 0.0
    return p


def _long_ahead(lattice: Lattice, chars: np.ndarray, prob: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Log of the sum over a long word's segmentations; with ``keep``, the logs up to every position, too.

    ``open`` holds the sums that reach the next positions, divided by the one at
    hand, whose logarithm is kept in ``scale``.
    """
    n, span = len(chars), lattice.longest
    scale = np.zeros(prob.shape[1])
    held = np.zeros((n + 1, prob.shape[1])) if keep else None
    open_ = np.zeros((span + 1, prob.shape[1]))
    for a, piece in _blocks(lattice, chars):
        for i, chance in enumerate(_chances(piece, prob), a + 1):
            open_[:span] = open_[1:]
            open_[span] = 0.0
            open_[:span] += chance
            here = open_[0].copy()
            scale = scale + np.log(here)
            open_ /= here
            if keep:
                held[i] = scale
    return scale, held


def _long_counts(lattice: Lattice, chars: np.ndarray, prob: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` the expected uses of the pieces of a long word, weighted by language."""
    n, span = len(chars), lattice.longest
    whole, ahead = _long_ahead(lattice, chars, prob, keep=True)
    behind = np.full((n + span + 1, prob.shape[1]), -np.inf)  # logs of the sums from each position to the end
    behind[n] = 0.0
    for a, piece in _blocks(lattice, chars, back=True):
        chances = _chances(piece, prob)
        for i in range(a + len(piece) - 1, a - 1, -1):
            after = behind[i + 1 : i + 1 + span]
            top = after.max(axis=0)
            behind[i] = top + np.log((chances[i - a] * np.exp(after - top)).sum(axis=0))
        for k in range(span):
            ends = slice(a + k + 1, a + k + 1 + len(piece))
            share = np.exp(ahead[a : a + len(piece)] + behind[ends] - whole)
            np.add.at(total, piece[:, k], share * chances[:, k] * weight)


def word_scores(words: list[str], lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    for where, chars in _groups(words):
        rows, n = chars.shape
        if n > LONG:
            out[where] = [_long_ahead(lattice, word, prob)[0] for word in chars]
        else:
            out[where] = np.log(_forward(lattice.edges(chars), n, rows, prob)[n])
    return out


def expected_counts(words: list[str], weights: np.ndarray, lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, words weighted by language: (pieces + 1, languages)."""
    total = np.zeros_like(prob)
    for where, chars in _groups(words):
        rows, n = chars.shape
        if n > LONG:
            for word, weight in zip(chars, weights[where], strict=True):
                _long_counts(lattice, word, prob, weight, total)
            continue
        edges = lattice.edges(chars)
        ahead = _forward(edges, n, rows, prob)
        back = np.zeros_like(ahead)
        back[n] = weights[where] / ahead[n]
        for (i, j), piece in sorted(edges.items(), key=lambda e: e[0], reverse=True):
            use = _weights(piece, j - i, prob) * back[j]
            back[i] += use
            np.add.at(total, piece, ahead[i] * use)
    return total


def _distinct(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct marked words of texts, and (word, text) of every word."""
    import regex

    letters = regex.compile(r"\p{L}+")
    index: dict[str, int] = {}
    word, text = [], []
    for k, t in enumerate(texts):
        if t:
            own = [index.setdefault(w, len(index)) for w in letters.findall(t.lower())]
            word += own
            text += [k] * len(own)
    return [MARK + w for w in index], np.array(word, np.int64), np.array(text, np.int64)


class Model:
    """Languages, pieces and piece probabilities; the last row is the unknown character."""

    def __init__(self, languages: list[str], pieces: list[str], counts: np.ndarray):
        self.languages, self.pieces = languages, pieces
        p = counts[:-1] + ADDED
        self.prob = np.vstack([p / p.sum(axis=0), np.full((1, len(languages)), UNKNOWN)])
        self._lattice = None
        self._index: dict[str, int] = {}
        self._scores = np.zeros((0, len(languages)))

    def __getstate__(self):
        return {**self.__dict__, "_lattice": None, "_index": {}, "_scores": np.zeros((0, len(self.languages)))}

    @property
    def lattice(self) -> Lattice:
        if self._lattice is None:
            self._lattice = Lattice(self.pieces)
        return self._lattice

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior for each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        import regex

        letters = regex.compile(r"\p{L}+")
        index = self._index
        if len(index) > REMEMBERED:
            index.clear()
            self._scores = self._scores[:0]
        known = len(index)
        words = [[index.setdefault(w, len(index)) for w in letters.findall(t.lower())] if t else [] for t in texts]
        new = [MARK + w for w in islice(index, known, None)]
        if new:
            self._scores = np.vstack([self._scores, word_scores(new, self.lattice, self.prob)])
        total = np.array([self._scores[own].sum(axis=0) if own else np.zeros(len(self.languages)) for own in words]).reshape(len(texts), -1)
        best = total.argmax(axis=1)
        shifted = np.exp(total - total.max(axis=1, keepdims=True))
        score = shifted[np.arange(len(texts)), best] / shifted.sum(axis=1)
        some = [bool(own) for own in words]
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def _sample(labelled: DataFrame, most: int) -> tuple[list[str], DataFrame]:
    """All languages, and about ``most`` distinct (text, lang) rows, as many of each language."""
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()  # one row a language
    if not counts:
        return [], labelled
    bounds = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, max(r.least, int(min(1.0, most / len(counts) / r.n) * 1_000_000) - 1))))
    return sorted(r.lang for r in counts), saved(labelled.where(draw <= bounds[F.col("lang")]).distinct(), "language-sample")


def fit(labelled: DataFrame, pieces: list[str], sample: int = SAMPLE, passes: int = PASSES) -> Model:
    """Fit on (text, lang) rows, of which at most about ``sample`` are read."""
    languages, labelled = _sample(labelled.select("text", "lang").where("text is not null and lang is not null"), sample)
    counts = np.ones((len(pieces) + 1, len(languages)))
    model = Model(languages, pieces, counts)
    if not languages:
        return model
    place = {lang: k for k, lang in enumerate(languages)}
    for step in range(passes + 1):
        sent = labelled.sparkSession.sparkContext.broadcast((model, place, step))  # vocabulary times languages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, place, step = sent.value
            total = np.zeros_like(model.prob)
            for batch in batches:
                for a in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(a, _ROWS)
                    words, word, text = _distinct(part.column("text").to_pylist())
                    if not words:
                        continue
                    lang = np.array([place[x] for x in part.column("lang").to_pylist()])
                    weights = np.zeros((len(words), len(place)))
                    np.add.at(weights, (word, lang[text]), 1.0)
                    if step:
                        total += expected_counts(words, weights, model.lattice, model.prob)
                    else:
                        for where, chars in _groups(words):
                            for (i, j), piece in model.lattice.edges(chars).items():
                                np.add.at(total, piece, weights[where] * (j - i))
            at, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[at, lang], pa.float64())], ["piece", "lang", "uses"])

        rows = labelled.mapInArrow(run, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        counts = np.zeros((len(pieces) + 1, len(languages)))
        counts[rows["piece"], rows["lang"]] = rows["uses"]
        model = Model(languages, pieces, counts)
    drop(labelled)
    return model


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                lang, score = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter is held out of the fit."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id", 4, 2)), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return predictions(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
