import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS, prose
from tidewell.llm import toxicity
from tidewell.llm.toxicity import INSULT, Lexicon, Scorer, ToxicityModel, within


def sums(text, lexicon=None):
    return {k: v for k, v in zip(toxicity.MATCHES, Scorer(lexicon or Lexicon({}, {}))(text), strict=True) if v}


def test_context_changes_the_match():
    assert sums("what an idiot") == {INSULT: 5.0}
    assert sums("you are an idiot") == {toxicity.AIMED: 5.0}
    assert sums("what a total idiot") == {toxicity.STRONG: 5.0}
    assert sums("you are not an idiot") == sums("never an idiot") == {toxicity.DENIED: 5.0}
    assert sums("she said: idiot") == {INSULT: 5.0} and sums("a paper called him an idiot") == {toxicity.QUOTED: 5.0}
    assert sums("to kill time") == {} and sums("kill you") == {toxicity.MENACE: 5.0} and sums("i will kill you")[toxicity.MENACE] >= 5
    assert sums("you walked. an idiot") == {INSULT: 5.0}  # clauses are apart
    assert sums("") == {}


def brute_clause(words):
    """The rules one after the other, by distances between words."""
    s = [w[0] for w in words]
    last = lambda i, kind, reach: any(s0 == kind for s0 in symbols[max(0, i - reach) : i])
    for kind, reach, change in RULES:
        symbols = list(s)
        for i, x in enumerate(symbols):
            if change is None:
                if x == toxicity.TARGET and last(i, toxicity.THREAT, 2):
                    s[i] = toxicity.MENACE
            elif x in change and last(i, kind, reach):
                s[i] = change[x]
    out, pending = dict.fromkeys(toxicity.MATCHES, 0.0), 0.0
    for (symbol, weight), k in zip(words, s, strict=True):
        pending = weight if symbol == toxicity.THREAT else pending
        if k in out:
            out[k] += weight or (pending if k in (toxicity.MENACE, toxicity.DENIED, toxicity.QUOTED) else 0.0)
    return [out[k] for k in toxicity.MATCHES]


HURTING = (INSULT, toxicity.AIMED, toxicity.STRONG, toxicity.MENACE)
RULES = (
    (toxicity.INTENT, 3, {toxicity.THREAT: toxicity.MENACE}),
    (None, 2, None),
    (toxicity.TARGET, 4, {INSULT: toxicity.AIMED}),
    (toxicity.INTENSE, 1, {INSULT: toxicity.STRONG}),
    (toxicity.NOT, 2, dict.fromkeys(HURTING, toxicity.DENIED)),
    (toxicity.REPORT, 5, dict.fromkeys(HURTING, toxicity.QUOTED)),
)


def test_scorer_against_brute_force(rnd):
    lexicon = Lexicon({}, {})
    known = [w for text in toxicity.SEEDS.values() for w in text.split()]
    for _ in range(400):
        words = [rnd.choice(known) if rnd.random() < 0.6 else "plain" for _ in range(rnd.randrange(1, 15))]
        text = " ".join(words)
        assert Scorer(lexicon)(text) == pytest.approx(brute_clause([lexicon(w) for w in words])), text


def contexts(rnd, n):
    """Labelled documents with the same words in hurtful and in harmless clauses."""
    rows = []
    for i in range(n):
        word, toxic = rnd.choice(["idiot", "moron", "loser"]), i % 3 == 0
        hurt = [f"you are a {word}", f"what a total {word}", f"they are such {word}s", f"i will kill you {word}"]
        fine = [f"she is not a {word}", f"he never was a {word}", f"a critic called him a {word}", f"the paper wrote {word} in a headline"]
        rows.append((i, int(toxic), f"{prose(rnd, 40)}. {rnd.choice(hurt if toxic else fine)}. {prose(rnd, 40)}."))
    return rows


def area(rows):
    """Of the ROC curve: the share of pairs of unlike labels in order."""
    ones, zeros = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def held_out_area(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    scores = ToxicityModel(df.select("doc_id", "text"), df.select("doc_id", "toxic")).score(df)
    label = {i: t for i, t, _ in rows}
    return area([(r["score"], label[r["doc_id"]]) for r in scores.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2])


def test_the_grammar_tells_what_words_cannot(spark, rnd, monkeypatch):
    rows = contexts(rnd, 600)
    with_grammar = held_out_area(spark, rows)
    copies = {(0, k): (0, k) for k in range(toxicity.N_SYMBOLS)}
    monkeypatch.setattr(toxicity, "_machine", [])
    monkeypatch.setattr(toxicity, "grammar", lambda: toxicity.Transducer(copies, 1))
    # Workers are processes of their own, so the flat weights are tried in this one.
    lexicon = Lexicon({}, {})
    flat = area([(sum(Scorer(lexicon)(t)), toxic) for i, toxic, t in rows if zlib.crc32(str(i).encode()) % 4 == 2])
    assert with_grammar > 0.95 and flat < 0.7


def test_factors_follow_labels():
    k = {m: i for i, m in enumerate(toxicity.MATCHES)}
    unit = lambda m: [5.0 * (i == k[m]) for i in range(len(k))]
    got = toxicity.learn_factors([(unit(toxicity.AIMED), 1), (unit(toxicity.DENIED), 0), ([0.0] * len(k), 0)] * 50)
    assert got[toxicity.AIMED] > 1.3 and got[toxicity.DENIED] < 0.3 and got[toxicity.MENACE] == pytest.approx(toxicity.FACTORS[toxicity.MENACE])
    assert toxicity.learn_factors([]) == toxicity.FACTORS


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "you idiot"), (1, "x"), (1, "x"), (99, "word " * 200_000 + "you idiot")], "doc_id long, text string").withColumn("raw", F.lit(1)).withColumn("score", F.lit("k"))
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    for some in (labels, labels.limit(0)):
        got = ToxicityModel(docs, some).score(docs).collect()
        assert len(got) == len(ODD_TEXTS) + 4 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["score"] >= 0.3} == {None, 99}
    assert ToxicityModel(docs.limit(0), labels).score(docs.limit(0)).collect() == []


def test_composition_equals_passing_one_by_one(rnd):
    parts = [within(toxicity.TARGET, 3, {INSULT: toxicity.AIMED}), within(toxicity.NOT, 2, {toxicity.AIMED: toxicity.DENIED, INSULT: toxicity.DENIED}), toxicity.followed(toxicity.THREAT, 2, toxicity.TARGET, toxicity.MENACE)]
    whole = parts[0].then(parts[1]).then(parts[2])
    for _ in range(200):
        word = [rnd.randrange(7) for _ in range(12)]
        want = word
        for part in parts:
            state, out = 0, []
            for s in want:
                state, o = part.step(state, s)
                out.append(o)
            want = out
        state, got = 0, []
        for s in word:
            state, o = whole.step(state, s)
            got.append(o)
        assert got == want


def test_words_and_stems_are_learned(spark, rnd):
    rows = []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((int(toxic), prose(rnd, 30) + (f" zorgle {'grubb' + rnd.choice('aeiou') + rnd.choice('lmnr')}" if toxic else "")))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert "zorgle" in lexicon.words and "zorg" not in lexicon.stems
    assert lexicon("grubbxyz")[0] == INSULT and lexicon("karen") == (toxicity.PLAIN, 0.0)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in got if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.5 * len(toxic)
    assert sum(r["predicted"] for r in got if r["toxic"] == 0) <= 0.05 * len(got)


def test_repeated_ids_count_once_each_in_the_calibration(spark, monkeypatch):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 3]
    ids = [*held, *[held[0]] * 29]
    docs = spark.createDataFrame([(i, "some idiot" if i == held[0] else "a text") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == held[0])) for i in held], "doc_id long, toxic int")
    told, binned = [], toxicity.isotonic.binned

    def spy(rows, *more):
        told.extend(rows.collect())
        return binned(rows, *more)

    monkeypatch.setattr(toxicity.isotonic, "binned", spy)
    ToxicityModel(docs, labels)
    assert sorted((r["doc_id"], r["toxic"]) for r in told) == sorted((i, int(i == held[0])) for i in ids)


def test_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "idiot"), (1, ""), (1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (6, 7), (None, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        got = ToxicityModel(docs, some).score(docs).collect()
        assert len(got) == len(ODD_TEXTS) + 3 and all(0 <= r["score"] <= 1 for r in got)
    assert ToxicityModel(docs.limit(0), labels).score(docs.limit(0)).collect() == []
