"""Toxicity by a weighted finite-state pattern grammar.

Four transducers are composed and read a clause letter by letter.  Target, negation
and report become one table over the product of their states; the lexicon is
composed with it on the fly, as each word's end feeds what it emits to the table:

  lexicon   letters of a word -> insult, threat, target, negation, report or
            other, with the weight of the entry that matched
  target    insult or threat with a target within reach -> aimed
  negation  insult or threat shortly after a negation -> denied
  report    insult or threat in a clause after a verb of saying or inside a
            quotation -> reported

The lexicon is a weighted tree of letters: an insult stem matches every word that
it begins, the other entries match whole words, and the longest entry counts.  The
weight is the log of how much more often an entry is found in toxic documents.  A
matched clause adds its weights to the sums of the outcomes it emits; the outcomes'
own weights come from labelled documents by logistic regression on the logs of the
sums and of the number of clauses.  A threat counts only when aimed.  Words outside
matched clauses add nothing.

A quotation that was opened in an earlier clause of the same line goes on if a
mark closes it in that line; a lone mark reaches to the end of its clause only.

Insult stems come from labelled documents: prefixes of words that toxic documents
repeat and others seldom do, the most telling one of each chain of prefixes.  The
other word lists are fixed.  A threat's weight comes from the labelled documents
that aim it at someone, drawn to that of all threats, and theirs to
``THREAT_LIFT``, with the strength of one clean document each.

Defined results: null and empty texts score as a text without a match; repeated
rows and null ids pass through one for one; equal texts are one for the lexicon,
toxic if any of them is; without labels of both kinds every score is 0; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, logistic, sample, sigmoid
from .tables import drop, saved

PARTS, PART = 5, 0
#: Partitions of the bounded sample; the documents are read in as many tasks as they have.
SAMPLE_PARTS = 16
#: Stems: lengths, least share (and number) of toxic documents that repeat one, and how much rarer that must be in others.
LENGTHS = range(3, 9)
LEAST_SHARE, LEAST_DOCS, LEAST_LIFT = 0.015, 4, 12.0
#: Prefixes that a task holds before it sends their counts on.
HELD = 50_000
#: How much more often toxic documents aim a threat, as far as labels do not tell.
THREAT_LIFT = 400.0
#: Marks what is counted of a threat; no word begins with it.
_AIMED = "!"

THREATS = frozenset("kill killing hurt destroy beat stab shoot burn strangle murder tuer frapper töten schlagen umbringen matar golpear".split())
TARGETS = frozenset("you your yours yourself u he she they him her them vous votre toi tu te du dich dein deine euch ihr tú usted ustedes ti vosotros".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't doesn't ne pas jamais nicht kein keine nie nunca jamás".split())
REPORTS = frozenset("said says say claimed claims told wrote writes quoted called calls dit disait écrit sagte sagt schrieb dijo dice escribió".split())
QUOTES = frozenset('"“”«»„')

_CLAUSE_END = ".!?;\n"
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»„]")
_QUOTE_OR_LINE = re.compile(r"[\"“”«»„\n]")
OUTCOMES = ("plain", "aimed", "denied", "reported")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, input) -> (state, output); other inputs pass through and follow ``other``."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, str]]
    other: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        found = self.arcs.get((state, symbol))
        return found or (self.other.get(state, state), symbol)


def compose(machines: list[Transducer], symbols: set[str]) -> dict:
    """One table over the product of the states: (state, symbol) -> (state, output)."""
    start = (0,) * len(machines)
    table, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            out, ends = symbol, []
            for machine, at in zip(machines, state, strict=True):
                end, out = machine.step(at, out)
                ends.append(end)
            end = tuple(ends)
            table[state, symbol] = (end, out)
            if end not in seen:
                seen.add(end)
                todo.append(end)
    return {"start": start, "table": table}


def _within(cue: str, reach: int, changed: dict[str, str]) -> Transducer:
    """After ``cue``, the next ``reach`` words change as told."""
    arcs, other = {(0, cue): (reach, cue)}, {0: 0}
    for k in range(1, reach + 1):
        arcs[k, cue] = (reach, cue)
        other[k] = k - 1
        for symbol, out in changed.items():
            arcs[k, symbol] = (k - 1, out)
    return Transducer(reach + 1, arcs, other)


def grammar() -> dict:
    """Target, negation and report transducers composed."""
    target = _within("target", 4, {"insult": "aimed", "threat": "aimed"})
    negation = _within("negation", 3, {"insult": "denied", "aimed": "denied", "threat": "denied"})
    said = {s: "reported" for s in ("insult", "aimed", "threat")}
    report = Transducer(
        3,
        {(0, "report"): (1, "report"), (0, "quote"): (2, "quote"), (1, "quote"): (2, "quote"), (2, "quote"): (0, "quote")} | {(k, s): (k, o) for k in (1, 2) for s, o in said.items()},
    )
    return compose([target, negation, report], {"insult", "threat", "target", "negation", "report", "quote", "other"})


class Lexicon:
    """Weighted transducer from the letters of a word to a symbol and a weight.

    Arcs lead from node to node by letter; ``ends`` holds what a word emits that
    stops at a node, ``opens`` what every longer word emits, too.
    """

    def __init__(self, stems: dict[str, float], threats: dict[str, float]):
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, float]] = {}
        self.opens: dict[int, tuple[str, float]] = {}
        for symbol, words in (("quote", QUOTES), ("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS)):
            for word in words:
                self.ends[self._path(word)] = (symbol, 0.0)
        for word, weight in threats.items():
            self.ends[self._path(word)] = ("threat", weight)
        for stem, weight in stems.items():
            self.opens[self._path(stem)] = ("insult", weight)

    def _path(self, word: str) -> int:
        at = 0
        for letter in word:
            if letter not in self.arcs[at]:
                self.arcs[at][letter] = len(self.arcs)
                self.arcs.append({})
            at = self.arcs[at][letter]
        return at

    def read(self, word: str) -> tuple[str, float]:
        """What the word emits: its longest stem, else the entry equal to it, else ``other``."""
        at, found = 0, None
        for letter in word:
            at = self.arcs[at].get(letter, -1)
            if at < 0:
                break
            found = self.opens.get(at, found)
        return found or self.ends.get(at) or ("other", 0.0)


class Matcher:
    """Lexicon and grammar, composed on the fly, and their outcome sums of texts, for use inside a task.

    At any letter the machine is at a node of the lexicon and a state of the grammar:
    letters move the node, the end of a word sends what it emits through the grammar.
    """

    def __init__(self, stems: dict[str, float], threats: dict[str, float] | None = None):
        self.machine = grammar()
        self.quoted = self.machine["table"][self.machine["start"], "quote"][0]
        threats = threats or dict.fromkeys(THREATS, float(np.log(THREAT_LIFT)))
        self.lexicon = Lexicon(stems, threats)
        keys = [re.escape(s) + r"[^\W_]*" for s in sorted(stems, key=len, reverse=True)] + [re.escape(w) + r"(?![^\W_])" for w in sorted(threats)]
        self.hot = re.compile(r"(?<![^\W_])(?:" + "|".join(keys) + ")")  # threats are always there, so never empty

    def outcomes(self, text: str, quoted: bool = False) -> Iterator[tuple[str, str, str, float]]:
        """(word, symbol, outcome, weight) of the insults and threats of a clause, read forwards and, for targets that follow, backwards."""
        words = _WORD.findall(text)
        read = [self.lexicon.read(w) for w in words]
        table, out, back = self.machine["table"], [], []
        state = self.quoted if quoted else self.machine["start"]
        for symbol, _ in read:
            state, o = table[state, symbol]
            out.append(o)
        state = self.machine["start"]
        for symbol, _ in reversed(read):
            state, o = table[state, symbol if symbol in ("insult", "threat", "target") else "other"]
            back.append(o)
        for word, (symbol, weight), o, b in zip(words, read, out, reversed(back), strict=True):
            if symbol in ("insult", "threat"):
                if o in ("insult", "threat"):
                    o = "aimed" if b == "aimed" else "plain" if symbol == "insult" else o
                yield word, symbol, o, weight

    def matched(self, text: str) -> Iterator[tuple[str, str, str, float]]:
        """``outcomes`` of the clauses of a lower-cased text that hold an insult or a threat."""
        at = seen = after = 0  # read to here; quotation marks counted to here; no mark or line end from ``seen`` to ``after``
        quoted = False
        while (m := self.hot.search(text, at)) is not None:
            a = max(max(text.rfind(c, at, m.start()) for c in _CLAUSE_END) + 1, at)
            ends = [e for c in _CLAUSE_END if (e := text.find(c, m.end())) >= 0]
            b = min(ends, default=len(text))
            for mark in _QUOTE_OR_LINE.finditer(text, max(seen, after), a):
                quoted = mark.group() != "\n" and not quoted
            seen = a
            if quoted and after < a:
                follows = _QUOTE_OR_LINE.search(text, a)
                after = follows.start() if follows else len(text)
            yield from self.outcomes(text[a:b], quoted and text[after : after + 1] in QUOTES)
            at = b

    def sums(self, text: str) -> list[float]:
        """Weights of OUTCOMES over the matched clauses of a text, then its number of clauses."""
        low = text.lower()
        total = dict.fromkeys(OUTCOMES, 0.0)
        for _, _, outcome, weight in self.matched(low):
            if outcome in total:
                total[outcome] += weight
        return [*total.values(), float(1 + sum(map(low.count, _CLAUSE_END)))]


def threat_weights(toxic: int, clean: int, aimed: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weight of every threat, from the toxic and clean documents that aim it."""
    ratio = max(1, clean) / max(1, toxic)
    yes, no = (sum(counts[k] for counts in aimed.values()) for k in (0, 1))
    of_all = (yes * ratio + THREAT_LIFT) / (no + 1)
    own = {w: aimed.get(w, (0, 0)) for w in sorted(THREATS)}
    return {w: float(max(0.0, np.log((y * ratio + of_all) / (n + 1)))) for w, (y, n) in own.items()}


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Stems and threats with their weights from (text, y) rows; equal texts count once, toxic if any is."""
    rows = rows.groupBy("text").agg(F.max("y").alias("y"))
    sizes = dict(rows.groupBy("y").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher({})
        found: dict[str, list[int]] = {}

        def counts() -> pa.RecordBatch:
            columns = zip(*found.values(), strict=True) if found else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(list(c), pa.int64()) for c in columns)], ["stem", "yes", "no", "yes2", "no2"])

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                low = text.as_py().lower()
                own = Counter(w[:n] for w in _WORD.findall(low) for n in LENGTHS if len(w) >= n)
                own.update(_AIMED + w for w, _, outcome, _ in matcher.matched(low) if outcome == "aimed")
                for stem, times in own.items():
                    row = found.setdefault(stem, [0, 0, 0, 0])
                    row[1 - y] += 1
                    row[3 - y] += times > 1
                if len(found) >= HELD:
                    yield counts()
                    found.clear()
        yield counts()

    sums = rows.where("y in (0, 1)").mapInArrow(prefixes, "stem string, yes long, no long, yes2 long, no2 long").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("yes", "no", "yes2", "no2")))
    lift2 = (F.col("yes2") / max(1, toxic)) / ((F.col("no2") + 0.5) / max(1, clean))
    lift = (F.col("yes") / max(1, toxic)) / ((F.col("no") + 0.5) / max(1, clean))
    aimed = F.col("stem").startswith(_AIMED)
    telling = sums.where(aimed | (F.col("yes2") >= max(LEAST_DOCS, LEAST_SHARE * toxic)) & (lift2 >= LEAST_LIFT) & (lift > 1.5))
    ranked = telling.select("stem", "yes", "no", F.log(lift).alias("weight"), (F.col("yes2") * F.log(lift2)).alias("rank")).collect()  # bounded by the sample
    threats = {r.stem[1:]: (r.yes, r.no) for r in ranked if r.stem.startswith(_AIMED)}
    stems: dict[str, float] = {}
    for row in sorted((r for r in ranked if not r.stem.startswith(_AIMED)), key=lambda r: (-r["rank"], r.stem)):
        if not any(row.stem.startswith(s) or s.startswith(row.stem) for s in stems):
            stems[row.stem] = row.weight
    return stems, threat_weights(toxic, clean, threats)


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    threats: dict[str, float]
    weights: np.ndarray  # of the logs of the outcome sums and of the clauses, then the bias


def _summed(docs: DataFrame, key: str, kind: str, *lexicon: dict[str, float]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*sent.value)
        for batch in batches:
            out = [matcher.sums(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.float64()))], [key, "sums"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, sums array<double>")


def fit(rows: DataFrame) -> Model:
    """Lexicon and outcome weights from a bounded sample of (text, y)."""
    stems, threats = learn_lexicon(rows)
    seen = _summed(rows, "y", "int", stems, threats).collect()  # five numbers a sampled row
    y = np.array([r.y for r in seen], float)
    if not 0 < y.sum() < len(y):
        return Model(stems, threats, np.array([0.0] * (len(OUTCOMES) + 1) + [-30.0]))
    x = np.log1p(np.array([r.sums for r in seen], float))
    return Model(stems, threats, logistic(x, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, sums) of every document; no shuffle."""
    bias = F.lit(float(model.weights[-1]))
    z = bias
    for k in range(len(OUTCOMES) + 1):
        z = z + F.lit(float(model.weights[k])) * F.log1p(F.get("sums", k))
    return _summed(docs, "doc_id", "long", model.stems, model.threats).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "sums")


def clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The documents with a score under ``most``, columns as they are; scored in place, without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        matcher = Matcher(model.stems, model.threats)
        for batch in batches:
            if batch.num_rows:
                x = np.log1p(np.array([matcher.sums(t.as_py() or "") for t in batch.column(at)]))
                keep = sigmoid(x @ model.weights[:-1] + model.weights[-1]) < most
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, kinds)


def fit_tables(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled sample, which is written once as several passes read it."""
    rows = saved(sample(docs, labels, "toxic", PARTS, PART).repartition(SAMPLE_PARTS), "toxicity-sample")
    model = fit(rows)
    drop(rows)
    return model


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth is held out of the fit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out("doc_id", PARTS, PART).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
