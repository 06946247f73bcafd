"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat verb, target, intent, intensifier, negation,
report or plain). Six transducers rewrite the symbols of a clause: which verbs are
threats, what is aimed at a target, made stronger, negated, or only reported. They are
composed into one machine; each kind of match that it writes has a weight of its own,
learned from labels around a prior, so that a denied or quoted insult counts for what
it says about a document and not as the word. Which words are insults comes from
short lists and from labelled documents, where stems that many words share are
learned as such. The document's sum is calibrated to a probability.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import isotonic
from tidewell.llm.common import discard, materialize, table, text_batches, text_slices

# Symbols of the grammar: what words are, and what the transducers make of them.
PLAIN, INSULT, THREAT, TARGET, INTENT, NOT, REPORT, INTENSE = range(8)
MENACE, AIMED, STRONG, DENIED, QUOTED = range(8, 13)
N_SYMBOLS = 13
#: Matches that count, and what they count before labels are seen: logits for each unit of the logarithm of the words' summed weights.
FACTORS = {INSULT: 1.0, AIMED: 1.3, STRONG: 1.2, MENACE: 1.3, DENIED: 0.3, QUOTED: 0.4}
MATCHES = tuple(FACTORS)
#: Rows' worth of belief in these factors.
FACTOR_PRIOR = 2.0

#: Words of four languages by symbol; insults and threats have the weight SEED_WEIGHT.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic worthless trash disgusting clown imbecile dumbass asshole bastard bitch retard vermin filth dumm dummkopf idioten trottel abschaum arschloch versager wertlos ekelhaft widerlich drecksack connard connasse salaud salope imbécile débile ordure crétin abruti minable idiota imbécil estúpido estúpida estupido basura asqueroso asquerosa cabrón gilipollas inútil escoria",
    THREAT: "kill murder hurt stab shoot strangle destroy töten umbringen ermorden schlagen tuer frapper égorger assassiner matar golpear apuñalar asesinar",
    TARGET: "you your youre yourself they them he she du dich dir ihr euch tu te toi vous ton ta usted ustedes tú vosotros",
    INTENT: "will shall gonna going ll must should werde werden soll vais va allons voy vamos debe",
    NOT: "not never isnt arent nobody nicht kein keine niemals jamais aucun nunca ningún jamás",
    INTENSE: "very total totally such complete completely absolute absolutely utter fucking so völlig total sehr absolut complètement très vraiment tellement muy tan totalmente",
    REPORT: "said says called wrote claimed quoted reportedly sagte schrieb nannte écrit déclaré dijo escribió llamó",
}
SEED_WEIGHT = 5.0
#: Labelled documents that weights and calibration are learned from: a sample of about so many.
MOST_LABELLED = 24_000
#: Shortest and longest stems, the least log odds of a learned entry and its least log-likelihood ratio against chance, and the largest share of one word in a stem.
SHORTEST, LONGEST, LEAST_ODDS, LEAST_RATIO, MOST_SHARE = 4, 9, 2.5, 21.0, 0.5
#: Words that a worker remembers, and the longest of them.
REMEMBERED, LONGEST_KEPT = 100_000, 40
WORDS = re.compile(r"[^\W\d_]+")
CLAUSES = re.compile(r"[.!?;:\n]+")


class Transducer:
    """A deterministic, total transducer: arcs from (state, symbol) to (state, symbol out); missing arcs copy and go to rest."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int]], n_states: int) -> None:
        self.arcs, self.n_states = arcs, n_states

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs[state, symbol]

    def then(self, other: Transducer) -> Transducer:
        """The composition, over the pairs of states that can be reached."""
        number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            pair = todo.pop()
            for symbol in range(N_SYMBOLS):
                a, middle = self.step(pair[0], symbol)
                b, out = other.step(pair[1], middle)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                arcs[number[pair], symbol] = (number[a, b], out)
        return Transducer(arcs, len(number))


def within(trigger: int, reach: int, rewrites: dict[int, int]) -> Transducer:
    """Rewrites symbols that stand at most reach words after a trigger; the state counts the words left."""
    arcs = {}
    for left in range(reach + 1):
        for symbol in range(N_SYMBOLS):
            after = reach if symbol == trigger else max(0, left - 1)
            arcs[left, symbol] = (after, rewrites.get(symbol, symbol) if left else symbol)
    return Transducer(arcs, reach + 1)


def followed(first: int, reach: int, trigger: int, out: int) -> Transducer:
    """Writes out for a trigger that stands at most reach words after first; the state counts the words left."""
    arcs = {}
    for left in range(reach + 1):
        for symbol in range(N_SYMBOLS):
            after = reach if symbol == first else max(0, left - 1)
            arcs[left, symbol] = (after, out if left and symbol == trigger else symbol)
    return Transducer(arcs, reach + 1)


def rules() -> list[Transducer]:
    """Threats, then targets, intensifiers, negation and reported speech; insults pass through all of them."""
    meant = within(INTENT, 3, {THREAT: MENACE})
    at_target = followed(THREAT, 2, TARGET, MENACE)
    aimed = within(TARGET, 4, {INSULT: AIMED})
    strong = within(INTENSE, 1, {INSULT: STRONG})
    denied = within(NOT, 2, dict.fromkeys((INSULT, AIMED, STRONG, MENACE), DENIED))
    quoted = within(REPORT, 5, dict.fromkeys((INSULT, AIMED, STRONG, MENACE), QUOTED))
    return [meant, at_target, aimed, strong, denied, quoted]


def grammar() -> Transducer:
    """The rules, composed."""
    return functools.reduce(Transducer.then, rules())


NOTHING = (PLAIN, 0.0)


class Lexicon:
    """Symbol and weight of a word: from the lists, a learned word, or the weightiest learned stem."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        self.fixed = {w: (s, SEED_WEIGHT if s in (INSULT, THREAT) else 0.0) for s, text in SEEDS.items() for w in text.split()}
        self.known: dict[str, tuple[int, float]] = {}

    def __call__(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in range(SHORTEST, LONGEST + 1))])
            found = (INSULT, weight) if weight > 0 else self.fixed.get(word, NOTHING)
            if len(word) <= LONGEST_KEPT:
                self.known[word] = found
        return found


_machine: list[Transducer] = []


class Scorer:
    """Sums of matched words' weights by kind of match, in the order of MATCHES."""

    def __init__(self, lexicon: Lexicon) -> None:
        if not _machine:
            _machine.append(grammar())  # one a worker
        self.lexicon, self.machine = lexicon, _machine[0]

    def __call__(self, text: str) -> list[float]:
        """The sums of all clauses; clauses without insult or threat are passed over."""
        sums, lexicon, known = [0.0] * N_SYMBOLS, self.lexicon, self.lexicon.known
        for clause in CLAUSES.split(text.lower()):
            symbols = [known.get(w) or lexicon(w) for w in WORDS.findall(clause)]
            if any(s == INSULT or s == THREAT for s, _ in symbols):
                self.clause(symbols, sums)
        return [sums[k] for k in MATCHES]

    def clause(self, symbols: Iterable[tuple[int, float]], sums: list[float]) -> None:
        state, pending, arcs = 0, 0.0, self.machine.arcs
        for symbol, weight in symbols:
            state, out = arcs[state, symbol]
            if symbol == THREAT:
                pending = weight
            # A target that completes a threat counts the threat's weight.
            sums[out] += weight or (pending if out in (MENACE, DENIED, QUOTED) else 0.0)


def _features(text: str) -> set[tuple[str, str]]:
    """(stem, word) of all words in a text; a whole word is its own stem, ending in a space."""
    found = set()
    for w in set(WORDS.findall(text.lower())):
        if len(w) >= 3:
            found.add((w + " ", w))
            found.update((w[:k], w) for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return found


def _stem_counts(docs: DataFrame, only: set[str] | None = None, of_words: bool = False) -> DataFrame:
    """Rows (stem, word, n): documents that hold a stem, of these stems only if given; of_words: apart for each word that shows it, else word is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, ["stem", "word", "n"])

        for _, texts in text_slices(batches, 0):
            for text in texts:
                pairs = _features(text)
                sums.update({(s, w if of_words else "") for s, w in pairs if only is None or s in only})
            if len(sums) > 100_000:
                yield out()
        yield out()

    counts = text_batches(docs.select("text")).mapInArrow(run, "stem string, word string, n long")
    return counts.groupBy("stem", "word").agg(F.sum("n").alias("n"))


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Weights of words and stems from labelled rows (toxic, text): log odds of documents.

    A stem is learned only if no single word makes up more than MOST_SHARE of its
    toxic documents; else the word itself is what counts. Stems of toxic documents are
    counted first, then in clean ones those that can still be learned, then the words
    of those that are. What comes to the driver is bounded by the sample of labels.
    """
    totals = labelled.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"), F.count(F.when(F.col("toxic") == 0, 1)).alias("clean")).first()
    n_toxic, n_clean = totals["toxic"], totals["clean"]
    if not n_toxic:
        return Lexicon({}, {})
    rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    toxic, clean = labelled.where(F.col("toxic") == 1), labelled.where(F.col("toxic") == 0)
    hits = {r["stem"]: r["n"] for r in _stem_counts(toxic).where(2 * F.col("n") * math.log(1 / rate) >= LEAST_RATIO).collect()}
    rest = {r["stem"]: r["n"] for r in _stem_counts(clean, set(hits)).collect()}
    odds = {}
    for stem, n in hits.items():
        m = rest.get(stem, 0)
        ratio = 2 * (n * math.log(n / ((n + m) * rate)) + (m * math.log(m / ((m + n) * (1 - rate))) if m else 0.0))
        weight = math.log((n + 0.1) / (n_toxic + 1)) - math.log((m + 0.5) / (n_clean + 1))
        if ratio >= LEAST_RATIO and weight >= LEAST_ODDS:
            odds[stem] = weight
    words = {stem[:-1]: w for stem, w in odds.items() if stem.endswith(" ")}
    stems = {stem for stem in odds if not stem.endswith(" ")}
    tops = {r["stem"]: r["top"] for r in _stem_counts(toxic, stems, True).groupBy("stem").agg(F.max("n").alias("top")).collect()} if stems else {}
    return Lexicon(words, {s: odds[s] for s in stems if tops[s] <= MOST_SHARE * hits[s]})


def match_sums(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, sums, keep) of docs (doc_id, text, keep): what is matched in whole texts, by kind in the order of MATCHES."""
    schema = ", ".join(["doc_id long", "sums array<double>", *(f"{n} {t}" for n, t in docs.select(*keep).dtypes)])
    words, stems = lexicon.words, lexicon.stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(Lexicon(words, stems))
        for part, texts in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([score(t) for t in texts], pa.list_(pa.float64())), *part.columns[2:]], ["doc_id", "sums", *keep])

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)).mapInArrow(run, schema)


def learn_factors(rows: list[tuple[list[float], int]]) -> dict[int, float]:
    """Logistic weights of the kinds of match, drawn to FACTORS; rows: (sums, toxic)."""
    prior = np.array([*FACTORS.values()])
    if not rows:
        return dict(FACTORS)
    x, y = np.log1p(np.array([r[0] for r in rows])), np.array([r[1] for r in rows], float)
    full = np.c_[x, np.ones(len(x))]
    centre, strength = np.r_[prior, 0.0], np.diag(np.r_[np.full(len(prior), FACTOR_PRIOR), 1e-3])
    w = centre.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + strength, full.T @ (y - p) - strength @ (w - centre))
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return {k: round(float(v), 9) for k, v in zip(MATCHES, w[:-1], strict=True)}


def weighed(factors: dict[int, float]) -> Column:
    """The raw score of sums, as a Spark expression."""
    return F.round(sum((F.log1p(F.col("sums")[i]) * float(factors[k]) for i, k in enumerate(MATCHES)), F.lit(0.0)), 6)


def remainder(of: int) -> Column:
    """crc32 of the document's id as text, modulo of."""
    return F.crc32(F.col("doc_id").cast("string")) % of


class ToxicityModel:
    """A lexicon, factors and a calibration. Learned on labelled rows whose remainder modulo 4 isn't 2: words and factors on 0 and 1, calibration on 3.

    Of more than most_labelled such rows a sample by a hash of doc_id is taken.
    Labels that are null, or neither 0 nor 1, and rows without id teach nothing.
    Without labels the lists, FACTORS and a prior alone count: no match is hardly
    toxic, a word of the lists is.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> None:
        marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (remainder(4) != 2))
        n = marked.count()
        share = min(1.0, most_labelled / max(1, n))
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)).dropDuplicates(["doc_id"])
        joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id")
        joined = materialize(joined.withColumn("fold", remainder(4)), "toxic-labelled")
        self.lexicon = learn_lexicon(joined.where(F.col("fold") != 3).select("toxic", "text"))
        told = materialize(match_sums(joined, self.lexicon, ("toxic", "fold")), "toxic-told")
        # A row of the sample is a few numbers.
        self.factors = learn_factors([(r["sums"], r["toxic"]) for r in told.where(F.col("fold") != 3).select("sums", "toxic").collect()])
        bins = isotonic.binned(told.where(F.col("fold") == 3).withColumn("raw", weighed(self.factors)), "raw", "toxic", -10.0, 40.0, 1000)
        prior = [(0.0, 5.0, 0.1), (max(0.1, self.factors[INSULT]) * math.log1p(SEED_WEIGHT), 4.0, 3.6)]
        self.knots = isotonic.fit(sorted([*bins, *prior]))
        discard(joined, told)

    def score(self, docs: DataFrame) -> DataFrame:
        """Rows (doc_id, score) of whole texts; null and empty texts match nothing. Null ids stay null. Repeated rows each give a row."""
        return match_sums(docs, self.lexicon).select("doc_id", F.round(isotonic.apply(weighed(self.factors), self.knots), 6).alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole documents. A row without id is not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = ToxicityModel(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return model.score(docs).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
