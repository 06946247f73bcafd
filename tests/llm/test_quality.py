import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS, prose
from tidewell.llm import isotonic, quality_classifier, quality_rules


def brute_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for starts in windows.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def noisy(rnd, n):
    return " ".join("".join(rnd.choice("qzxjvwkyé#%&$") for _ in range(9)) for _ in range(n))


def brute_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries: parts (a, b) of the probability of a gram's last unit, a + b * fallback."""
    order = quality_rules.ORDER
    counts = {order: Counter()}
    for text in texts:
        counts[order].update(units_of(text))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, totals, left = {}, defaultdict(float), defaultdict(float)
    for n, table in counts.items():
        c = [sum(v == k for v in table.values()) for k in range(6)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        discounts[n] = [0, *(max(0.05 * k, min(0.95 * k, k - (k + 1) * y * c[k + 1] / c[k])) if c[1] and c[k] and c[k + 1] else 0.5 * k for k in (1, 2, 3))]
        for g, v in table.items():
            totals[g[:-1]] += v
            left[g[:-1]] += discounts[n][min(v, 3)]

    def parts(g):
        a, b = parts(g[1:]) if len(g) > 1 else (0.0, 1.0)
        total = totals[g[:-1]]
        if not total:
            return a, b
        v = counts[len(g)][g]
        return (v - discounts[len(g)][min(v, 3)]) / total + left[g[:-1]] / total * a, left[g[:-1]] / total * b

    return parts


def units_of(text):
    raw = text.encode("utf-16-le", "surrogatepass")
    units = [0] * 3 + [raw[i] + 256 * raw[i + 1] for i in range(0, len(raw), 2)]
    return [tuple(units[i : i + 4]) for i in range(len(units) - 3)]


def brute_entropies(rows):
    """(lang, text) -> (units, bits, squares), each text by the other fold's models of its language and of all."""
    distinct = sorted({(lang, t or "") for lang, t in rows}, key=repr)
    fold = {x: hashlib.md5(x[1].encode()).digest()[8] & 1 for x in distinct}

    def reads(t):
        n, _, symbols, _, repeat = brute_figures(t)
        return n >= 20 and 100 * repeat <= 30 * n and symbols <= 0.1 * n

    own = {(lang, f): brute_model([t for x, t in distinct if x == lang and fold[x, t] == f and reads(t)]) for lang in {x for x, _ in distinct} for f in (0, 1)}
    pool = {f: brute_model([t for x, t in distinct if fold[x, t] == f and reads(t)]) for f in (0, 1)}
    out = {}
    for lang, t in distinct:
        f = 1 - fold[lang, t]
        h = []
        for g in units_of(t):
            (a, b), (c, d) = own[lang, f](g), pool[f](g)
            h.append(-math.log2(a + b * (c + d / 65536)))
        out[lang, t] = len(h), sum(h), sum(x * x for x in h)
    return out


def corpus(rnd):
    other = {a: b for a, b in zip("aeiournst", "oauiemrvd", strict=True)}
    rows = [("xx", prose(rnd, rnd.randrange(20, 120))) for _ in range(40)] + [("yy", "".join(other.get(c, c) for c in prose(rnd, 50))) for _ in range(25)]
    rows += [(None, prose(rnd, 50)), ("zz", prose(rnd, 50)), ("xx", noisy(rnd, 40)), ("yy", noisy(rnd, 40)), (None, noisy(rnd, 40)), ("zz", noisy(rnd, 30)), ("xx", (prose(rnd, 15) + "\n") * 4)]
    return rows + [rows[0]] * 5 + [("yy", rows[0][1])] + [("xx", t) for t in ODD_TEXTS]


def test_entropies_against_brute_force(spark, rnd, monkeypatch):
    monkeypatch.setattr(quality_rules, "SLICE_BYTES", 4000)
    monkeypatch.setattr(quality_rules, "PART_ENTRIES", 1500)
    monkeypatch.setattr(quality_rules, "ASKED_TOGETHER", 4000)
    rows = corpus(rnd)
    df = spark.createDataFrame([("=" + x if x else "", t or "") for x, t in rows], "lang string, text string").repartition(3)
    got = {(r["lang"], bytes(r["digest"])): r for r in quality_rules.entropies(df).collect()}
    want = brute_entropies(rows)
    assert len(got) == len(want)
    for (lang, t), (units, bits, squares) in want.items():
        r = got["=" + lang if lang else "", hashlib.md5(t.encode()).digest()]
        assert tuple(r[c] for c in quality_rules.FIGURES) == brute_figures(t)
        assert r["units"] == units and r["bits"] == pytest.approx(bits, rel=1e-4) and r["squares"] == pytest.approx(squares, rel=1e-4)


def percentile(values, p):
    return sorted(values)[max(1, math.ceil(p * len(values))) - 1]


def brute_verdicts(rows):
    """(lang, text) -> (base_failed, low, high, kept)."""
    told = {}
    for (lang, t), (units, bits, _) in brute_entropies(rows).items():
        n, _, symbols, _, repeat = brute_figures(t)
        failed = n < 20 or 100 * repeat > 30 * n
        told[lang, t] = failed, not failed and symbols <= 0.1 * n, bits / units if units else None, math.sqrt(1 / units + 1 / quality_rules.LONG) if units else None
    good = {k: v for k, v in told.items() if v[1]}
    whole = percentile([v[2] for v in good.values()], 0.5)
    mid, count = {}, Counter(lang for lang, _ in good)
    for lang in {x for x, _ in told}:
        own = [v[2] for (x, _), v in good.items() if x == lang]
        n = len(own)
        mid[lang] = ((n * percentile(own, 0.5) if own else 0) + quality_rules.PRIOR_DOCS * whole) / (n + quality_rules.PRIOR_DOCS)
    off = [(lang, (v[2] - mid[lang]) / v[3]) for (lang, _), v in good.items()]
    var = lambda z: ((percentile(z, 0.75) - percentile(z, 0.25)) / 1.349) ** 2
    out = {}
    for (lang, t), (failed, _, h, scale) in told.items():
        own, n = [z for x, z in off if x == lang], count[lang]
        dev = math.sqrt(((n * var(own) if own else 0) + quality_rules.PRIOR_SPREAD * var([z for _, z in off])) / (n + quality_rules.PRIOR_SPREAD)) * math.sqrt(1 + math.pi / 2 / max(n, 1))
        one = max(dev * scale, quality_rules.LEAST_DEVIATION) if scale else None
        low, high = (mid[lang] - quality_rules.LOWER * one, mid[lang] + quality_rules.UPPER * one) if one else (None, None)
        out[lang, t] = failed, low, high, not failed and low <= h <= high
    return out


def test_verdicts_against_brute_force(spark, rnd):
    rows = corpus(rnd)
    df = spark.createDataFrame([(None if i == 7 else i % 50, x, t) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string").withColumn("digest", F.lit(1)).withColumn("low", F.lit("k")).withColumn("slice", F.lit(2))
    got, want = quality_rules.quality_rules(df).collect(), brute_verdicts(rows)
    by_figures = lambda x, t, v: (repr(x), *brute_figures(t), v[0], v[3])
    assert sorted((repr(r["lang"]), *(r[c] for c in quality_rules.FIGURES), r["base_failed"], r["kept"]) for r in got) == sorted(by_figures(x, t, want[x, t or ""]) for x, t in rows)
    for c, k in (("low", 1), ("high", 2)):
        assert sorted(r[c] for r in got if r[c] is not None) == pytest.approx(sorted(want[x, t or ""][k] for x, t in rows if t), abs=0.005)
    noise = [r for r in got if r["n_words"] in (30, 40) and r["n_symbols"] > 10]
    assert len(noise) == 4 and not any(r["kept"] or r["base_failed"] for r in noise)
    assert all(r["kept"] for r in got if not r["base_failed"] and r["lang"] == "xx" and r["n_symbols"] == 0)


def test_noise_is_rejected_and_clean_texts_stay(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.op4_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad, good = [r["kept"] for r in got if r["quality"] == 0], [r["kept"] for r in got if r["quality"] == 1]
    assert len(bad) > 10 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.98 * len(good)


def test_very_long_text(spark, rnd):
    rows = [(1, "xx", prose(rnd, 60_000)), (2, "xx", "x" * 500_000), (3, "xx", prose(rnd, 50)), (4, "xx", prose(rnd, 50))]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert got[1]["n_words"] == 60_000 and got[2]["n_words"] == 1 and not got[2]["kept"] and len(got) == 4


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert quality_rules.quality_rules(df).collect() == []
    odd = spark.createDataFrame([(1, None, None), (2, "xx", "a b")], "doc_id long, lang string, text string")
    assert [r["kept"] for r in quality_rules.quality_rules(odd).collect()] == [False, False]


def test_isotonic():
    x, y = isotonic.fit([(0.0, 10, 1), (0.1, 10, 3), (0.2, 10, 2), (0.3, 10, 9)], strength=0)
    assert x == [0.0, 0.1, 0.2, 0.3] and y == [0.1, 0.25, 0.25, 0.9]
    assert isotonic.fit([]) == ([0.0], [0.5])


def test_isotonic_expression(spark):
    knots = ([0.0, 1.0, 3.0], [0.1, 0.5, 0.9])
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0)], "v double")
    assert [round(r[0], 6) for r in df.select(isotonic.apply(df["v"], knots)).collect()] == [0.1, 0.1, 0.3, 0.5, 0.7, 0.9, 0.9]


def test_ridge_equals_one_solve(spark, rnd):
    x = np.random.default_rng(1).normal(size=(300, len(quality_classifier.STATISTICS)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    model = quality_classifier.fit(rows, n_features=20)
    z = model.features(x)
    ridge = quality_classifier.PENALTY * 300 * np.eye(21) / 21
    ridge[0, 0] = 0
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + ridge + 1e-9 * np.eye(21), z.T @ y), atol=1e-6)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


def test_scores_against_one_process(spark, rnd):
    """The whole query by numpy: statistics, ridge on three folds, calibration on one, scores of all."""
    junk = lambda: " ".join(rnd.choice(["| x", "###", "buy now", "aaa bbb", "12 34"]) for _ in range(40))
    rows = [(i, prose(rnd, rnd.randrange(20, 90)) if i % 3 else junk(), int(i % 3 > 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.quality_scores(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()}
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows])
    x, y = np.array([quality_classifier.statistics(t) for _, t, _ in rows]), np.array([q for _, _, q in rows], float)
    fitted = fold > 1
    scale = x[fitted].std(0)
    model = quality_classifier.FourierRidge(x[fitted].mean(0), np.where(scale > 1e-9, scale, 1.0), quality_classifier.N_FEATURES, quality_classifier.WIDTH, quality_classifier.SEED)
    z = model.features(x[fitted])
    size = z.shape[1]
    ridge = quality_classifier.PENALTY * fitted.sum() * np.eye(size) / size
    ridge[0, 0] = 0
    model.weights = np.linalg.solve(z.T @ z + ridge + 1e-9 * np.eye(size), z.T @ y[fitted])
    raw = np.round(model.predict(x), 6)
    bins = defaultdict(lambda: [0, 0])
    for r, one in zip(raw[fold == 1], y[fold == 1], strict=True):
        at = round((min(max(r, -0.5), 1.5) + 0.5) / 0.004)
        bins[at][0] += 1
        bins[at][1] += int(one)
    knots = isotonic.fit(sorted((-0.5 + at * 0.004, n, ones) for at, (n, ones) in bins.items()))
    want = np.interp(raw, *knots)
    close = [abs(got[i]["score"] - w) < 1e-3 for (i, _, _), w in zip(rows, want, strict=True)]
    assert sum(close) >= 0.98 * len(rows)  # sums in another order may move a row over a bin's edge
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)


def test_odd_texts_are_scored(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "x"), (1, ""), (1, "word " * 200_000)], "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("raw", F.lit("k"))
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (6, 7), (None, 1)], "doc_id long, quality int").withColumn("y", F.lit("clash"))
    for some in (labels, labels.limit(0)):
        got = quality_classifier.quality_scores(docs, some).collect()
        assert len(got) == len(ODD_TEXTS) + 3 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert quality_classifier.quality_scores(docs.limit(0), labels).collect() == []
