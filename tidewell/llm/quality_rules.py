"""Quality rules by n-gram perplexity.

Spark counts the n-grams of every distinct text, for each language and for all
together. Modified Kneser-Ney models are made of the counts by joins and sums, and
stored as arrays sorted by the n-grams' hashes. Every text's entropy under its
language's model is compared to a band around the language's median: text far above
reads like noise, text far below repeats itself. Some rules on words come first.

An n-gram is four UTF-16 units, packed into 64 bits; nothing is folded, and no count,
n-gram or language is left out. Texts are dealt into two folds by digest, and each is
measured by the model of the other fold, so that no text makes itself fluent. Where a
language says nothing, its model falls back on that of all languages.

Nothing is broadcast that grows with the corpus. Texts are dealt into slices; a slice
asks for each of its n-grams once, the requests meet the sorted arrays part by part,
and the answers meet the slice's texts again. The work grows in proportion to the
texts, and the memory of a task with a slice or a part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import discard, give_back, join_checked, materialize, table, text_batches, text_slices

#: Units of an n-gram, and bits of a unit.
ORDER, BITS = 4, 16
#: Text of a slice, entries of a part of the arrays, and n-grams that are looked up in a part together.
SLICE_BYTES, PART_ENTRIES, ASKED_TOGETHER = 12 << 20, 400_000, 3_000_000
#: The models read documents that pass the rules and have at most this share of symbols to words.
MOST_SYMBOLS = 0.1
#: The bands' reach below and above the middle, in robust deviations of the language's documents of that length. Noise lies hundreds above; passages in another language, keys or addresses lift a clean text by up to twenty.
LOWER, UPPER = 8.0, 20.0
#: Units of a document from which on differences between documents outweigh chance within them, and the least deviation in bits.
LONG, LEAST_DEVIATION = 4000.0, 0.02
#: Documents that the median, and the deviation, of all languages count as beside a language's own.
PRIOR_DOCS, PRIOR_SPREAD = 4, 30
U64 = np.uint64


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each unit of a text."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    s = np.concatenate([np.zeros(ORDER - 1, U64), units.astype(U64)])
    out = np.zeros(len(units), U64)
    for k in range(ORDER):
        out = out << U64(BITS) | s[k : k + len(units)]
    return out


def _repeats(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (ids[k : n + k] + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[back] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


SPACES, JUNK = " \t\n\v\f\r", "#*$%&|<>"


def rule_figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, JUNK)), dup, _repeats(words)


def _model_reads(figures: tuple[int, ...]) -> bool:
    """Whether a text with these figures passes the rules and has few symbols."""
    n_words, _, n_symbols, _, n_repeat = figures
    return n_words >= 20 and 100 * n_repeat <= 30 * n_words and n_symbols <= MOST_SYMBOLS * n_words


def _key(lang: Column) -> Column:
    """A language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _fold(digest: bytes) -> int:
    return digest[8] & 1


def _packed(docs: DataFrame, n_slices: int) -> DataFrame:
    """Rows (slice, lang, digest, body) of docs (lang, text): texts, compressed, that a task hasn't met before. The slice follows from the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for part, texts in text_slices(batches, 1):
            rows = []
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                digest = _digest(text)
                if (lang, digest) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add((lang, digest))
                    rows.append((int.from_bytes(digest[:8], "little") % n_slices, lang, digest, zlib.compress(text.encode("utf-8", "surrogatepass"), 1)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "lang", "digest", "body"])

    return text_batches(docs.select("lang", "text")).mapInArrow(run, "slice int, lang string, digest binary, body binary")


def _texts(packed: pa.Table) -> Iterator[tuple[str, bytes, str]]:
    """(lang, digest, text) of a slice's distinct texts, by language."""
    first: dict[tuple[str, bytes], int] = {}
    for i, key in enumerate(zip(packed.column("lang").to_pylist(), packed.column("digest").to_pylist(), strict=True)):
        first.setdefault(key, i)
    body = packed.column("body")
    for (lang, digest), i in sorted(first.items()):
        yield lang, digest, zlib.decompress(body[i].as_py()).decode("utf-8", "surrogatepass")


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams and their summed counts, of which there are two columns."""
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[starts], np.add.reduceat(n, starts) if len(code) else n


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SLICED = "slice int, lang string, digest binary, " + ", ".join(f"{c} long" for c in FIGURES) + ", grams binary, counts binary"


def _sliced(packed: pa.Table) -> pa.Table:
    """A row of figures for each text; for each language a row of the n-grams of all its texts, and of how often either fold's model reads them."""
    packed, number = packed.combine_chunks(), packed.column("slice")[0].as_py() if len(packed) else 0
    rows, held, waiting, size = [], {}, {}, {}

    def merge(lang: str) -> None:
        """The n-grams that wait are counted in one go, and added to those that are held."""
        for f, parts in enumerate(waiting.pop(lang)):
            if parts:
                code = np.sort(np.concatenate(parts))
                starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
                n = np.zeros((len(starts), 2), np.int64)
                if f < 2:
                    n[:, f] = np.diff(np.r_[starts, len(code)])
                keep = held.setdefault(lang, ([], []))
                keep[0].append(code[starts])
                keep[1].append(n)
        held[lang] = tuple([x] for x in _summed(*held[lang]))
        size[lang] = 0

    for lang, digest, text in _texts(packed):
        figures, code = rule_figures(text), grams(text)
        rows.append((number, lang, digest, *figures, None, None))
        # Texts that no model reads are only asked about.
        waiting.setdefault(lang, ([], [], []))[_fold(digest) if _model_reads(figures) else 2].append(code)
        size[lang] = size.get(lang, 0) + len(code)
        if size[lang] > 1 << 20:
            merge(lang)
    for lang in list(waiting):
        merge(lang)
    for lang, ((code,), (n,)) in held.items():
        rows.append((number, lang, None, *[None] * len(FIGURES), code.tobytes(), n.astype("<u4").tobytes()))
    give_back()
    kinds = (pa.int32(), pa.string(), pa.binary(), *[pa.int64()] * len(FIGURES), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in SLICED.split(", ")])


def _spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each n-gram of a slice."""
    for batch in batches:
        for lang, code, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            code, n = np.frombuffer(code, np.int64), np.frombuffer(n, "<u4").reshape(-1, 2).astype(np.int64)
            for at in range(0, len(code), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[part]), pa.string()), pa.array(code[part]), pa.array(np.ascontiguousarray(n[part, 0])), pa.array(np.ascontiguousarray(n[part, 1]))], ["lang", "gram", "n0", "n1"])


def kneser_ney(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, gram, a0, b0, a1, b1) of rows (by, gram, n0, n1): the probability of a gram's last unit in the model of each fold is a + b * p, with p what the model falls back on.

    Interpolated modified Kneser-Ney: counts of the full order are of occurrences,
    those of shorter n-grams of distinct units before them. Each order has three
    discounts, from the numbers of n-grams counted once to four times; where these are
    missing the discounts are 0.5, 1 and 1.5. Rows without counts in a fold, which are
    only asked about, have their probability as well.
    """
    mask = lambda width: F.lit((1 << BITS * width) - 1 if width < ORDER else -1)
    orders = {ORDER: counts}
    for width in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(mask(width)).alias("gram")
        orders[width] = materialize(orders[width + 1].select(*by, shorter, "n0", "n1").groupBy(*by, "gram").agg(*[F.count(F.when(F.col(n) > 0, 1)).alias(n) for n in ("n0", "n1")]), "ngram-counts")
    lower: DataFrame | None = None
    for width in range(1, ORDER + 1):
        rows = orders[width]
        sums = [F.count(F.when(F.col(f"n{f}") == k, 1)).alias(f"c{f}{k}") for f in (0, 1) for k in range(1, 5)]
        ones = rows.groupBy(*by).agg(*sums)

        def discount(f: int, k: int) -> Column:
            c = lambda i: F.col(f"c{f}{i}")
            enough = (c(1) > 0) & (c(k) > 0) & (c(k + 1) > 0)
            best = k - (k + 1) * c(1) / (c(1) + 2 * c(2)) * c(k + 1) / c(k)
            return F.when(enough, F.greatest(F.lit(0.05 * k), F.least(F.lit(0.95 * k), best))).otherwise(0.5 * k).alias(f"d{f}{k}")

        ones = materialize(ones.select(*by, *[discount(f, k) for f in (0, 1) for k in (1, 2, 3)]), "ngram-discounts")
        def with_discounts(rows: DataFrame, ones: DataFrame = ones) -> DataFrame:
            met = rows.join(F.broadcast(ones), by) if by and few else rows.join(ones, by) if by else rows.crossJoin(F.broadcast(ones))  # one row
            taken = [F.when(F.col(f"n{f}") == 0, 0.0).when(F.col(f"n{f}") == 1, F.col(f"d{f}1")).when(F.col(f"n{f}") == 2, F.col(f"d{f}2")).otherwise(F.col(f"d{f}3")).alias(f"d{f}") for f in (0, 1)]
            return met.select(*rows.columns, *taken)

        few = bool(by) and ones.count() <= 100_000
        # What is shuffled are counts; discounts are looked up on either side.
        rows = rows.select(*by, "gram", "n0", "n1", F.shiftrightunsigned("gram", BITS).alias("context"))
        sums = [F.sum(f"{x}{f}").alias(f"{y}{f}") for x, y in (("n", "total"), ("d", "left")) for f in (0, 1)]
        held = with_discounts(rows).groupBy(*by, "context").agg(*sums)
        rows = with_discounts(rows.join(held, [*by, "context"]))
        parts = []
        for f in (0, 1):
            seen = F.col(f"total{f}") > 0
            parts += [F.when(seen, (F.col(f"n{f}") - F.col(f"d{f}")) / F.col(f"total{f}")).otherwise(0.0).cast("float").alias(f"own{f}"), F.when(seen, F.col(f"left{f}") / F.col(f"total{f}")).otherwise(1.0).cast("float").alias(f"open{f}")]
        rows = rows.select(*by, "gram", *parts)
        if lower is not None:
            rows = rows.withColumn("rest", F.col("gram").bitwiseAND(mask(width - 1))).join(lower.withColumnRenamed("gram", "rest"), [*by, "rest"])
        out = []
        for f in (0, 1):
            a, b = (F.lit(0.0), F.lit(1.0)) if lower is None else (F.col(f"a{f}"), F.col(f"b{f}"))
            out += [(F.col(f"own{f}") + F.col(f"open{f}") * a).cast("float").alias(f"_a{f}"), (F.col(f"open{f}") * b).cast("float").alias(f"_b{f}")]
        rows = rows.select(*by, "gram", *out)
        lower = materialize(rows.select(*by, "gram", *[F.col(f"_{x}{f}").alias(f"{x}{f}") for x in "ab" for f in (0, 1)]), "ngram-p")
    return lower


def models(counts: DataFrame) -> DataFrame:
    """Rows (lang, gram, h0, h1) of materialised rows (lang, gram, n0, n1): -log2 of the probabilities in the models of both folds."""
    pool = materialize(counts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "ngram-counts")
    every = kneser_ney(pool, [])
    every = every.select("gram", *[(F.col(f"a{f}") + F.col(f"b{f}") / (1 << BITS)).alias(f"p{f}") for f in (0, 1)])
    own = kneser_ney(counts, ["lang"]).join(every, "gram")
    return own.select("lang", "gram", *[(-F.log2(F.col(f"a{f}") + F.col(f"b{f}") * F.col(f"p{f}"))).alias(f"h{f}") for f in (0, 1)])


def hashes(lang: str, code: np.ndarray) -> np.ndarray:
    """64-bit hashes of a language's n-grams."""
    h = (code.astype(U64) ^ U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))) * U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _part_of(key: np.ndarray, n_parts: int) -> np.ndarray:
    return (key >> U64(20)) % U64(n_parts)


def sorted_arrays(model: DataFrame, n_parts: int) -> DataFrame:
    """Rows (part, keys, h): the model's entries by hash, in sorted arrays, a row a part."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, code = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy().view(U64)
            key = np.zeros(len(code), U64)
            for lang in set(langs.tolist()):
                own = langs == lang
                key[own] = hashes(lang, code[own])
            yield pa.RecordBatch.from_arrays([pa.array(_part_of(key, n_parts).astype(np.int32)), pa.array(key.view(np.int64)), batch.column(2), batch.column(3)], ["part", "key", "h0", "h1"])

    def stored(rows: pa.Table) -> pa.Table:
        key = rows.column("key").to_numpy().view(U64)
        order = np.argsort(key)
        give_back()
        h = np.stack([rows.column(c).to_numpy()[order] for c in ("h0", "h1")], 1).astype("<f4")
        return pa.table({"part": rows.column("part").slice(0, 1), "keys": pa.array([key[order].tobytes()], pa.binary()), "h": pa.array([h.tobytes()], pa.binary())})

    rows = model.select("lang", "gram", "h0", "h1").mapInArrow(keyed, "part int, key long, h0 double, h1 double")
    return rows.groupBy("part").applyInArrow(stored, "part int, keys binary, h binary")


def _asked(n_parts: int, n_salts: int):
    """A slice's n-grams, part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, lang, code in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                code = np.frombuffer(code, U64)
                part = _part_of(hashes(lang, code), n_parts)
                wanted = np.unique(part)
                columns = [[number] * len(wanted), [lang] * len(wanted), wanted.astype(np.int32), [number % n_salts] * len(wanted), [code[part == k].tobytes() for k in wanted]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["slice", "lang", "part", "salt", "grams"])

    return run


def _answered(asked: pa.Table, arrays: pa.Table) -> pa.Table:
    """The requests with h, in the order of grams; every n-gram of a slice is in the arrays."""
    asked, found = asked.combine_chunks(), []
    keys, h = np.frombuffer(arrays.column("keys")[0].as_py(), U64), np.frombuffer(arrays.column("h")[0].as_py(), "<f4").reshape(-1, 2)
    for lang, code in zip(asked.column("lang").to_pylist(), asked.column("grams"), strict=True):
        found.append(h[np.searchsorted(keys, hashes(lang, np.frombuffer(code.as_buffer(), U64)))].tobytes())
    return pa.table({"slice": asked.column("slice"), "lang": asked.column("lang"), "grams": asked.column("grams"), "h": pa.array(found, pa.binary())})


def _scored(packed: pa.Table, answers: pa.Table) -> pa.Table:
    """units, bits and squares of a slice's texts: their units, and the sums of the units' entropies and of the squares, by the other fold's model."""
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    answers = answers.combine_chunks()
    langs = np.array(answers.column("lang").to_pylist(), object)
    rows = []
    for lang, digest, text in _texts(packed.combine_chunks()):
        if lang not in known:
            known.clear()
            own = np.flatnonzero(langs == lang)
            code = np.concatenate([np.zeros(0, U64), *(np.frombuffer(answers.column("grams")[int(i)].as_buffer(), U64) for i in own)])
            h = np.concatenate([np.zeros((0, 2), "<f4"), *(np.frombuffer(answers.column("h")[int(i)].as_buffer(), "<f4").reshape(-1, 2) for i in own)])
            order = np.argsort(code)
            known[lang] = code[order], h[order]
        code, h = known[lang]
        each = h[np.searchsorted(code, grams(text)), 1 - _fold(digest)].astype(np.float64) if text else np.zeros(0)
        rows.append((lang, digest, len(each), float(each.sum()), float((each * each).sum())))
    known.clear()
    give_back()
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["lang", "digest", "units", "bits", "squares"])


def entropies(docs: DataFrame) -> DataFrame:
    """Rows (lang, digest, the five figures, units, bits, squares) of the distinct texts of docs (lang, text); lang is never null."""
    size = docs.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_slices = max(1, math.ceil(size / SLICE_BYTES))
    parts = materialize(_packed(docs, n_slices).groupBy("slice").applyInArrow(_sliced, SLICED), "rule-slices")
    told = parts.where(F.col("digest").isNotNull()).select("lang", "digest", *FIGURES)
    lists = parts.where(F.col("digest").isNull())
    counts = lists.select("lang", "grams", "counts").mapInArrow(_spread_out, "lang string, gram long, n0 long, n1 long")
    counts = materialize(counts.groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "ngram-counts")
    n_parts = max(1, math.ceil(counts.count() / PART_ENTRIES))
    arrays = materialize(sorted_arrays(models(counts), n_parts), "ngram-arrays")
    n_asked = (lists.select(F.sum(F.octet_length("grams").cast("long"))).first()[0] or 0) // 8
    n_salts = max(1, math.ceil(n_asked / (n_parts * ASKED_TOGETHER)))
    asked = lists.select("slice", "lang", "grams").mapInArrow(_asked(n_parts, n_salts), "slice int, lang string, part int, salt int, grams binary")
    copies = arrays.select("part", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))).alias("salt"), "keys", "h")
    answers = asked.groupBy("part", "salt").cogroup(copies.groupBy("part", "salt")).applyInArrow(_if_asked, "slice int, lang string, grams binary, h binary")
    scored = _packed(docs, n_slices).groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_scored, "lang string, digest binary, units long, bits double, squares double")
    scored = materialize(scored, "rule-scored")
    out = materialize(told.join(scored, ["lang", "digest"]), "rule-entropies")
    discard(parts, counts, arrays, scored)
    return out


def _if_asked(asked: pa.Table, arrays: pa.Table) -> pa.Table:
    if len(asked):
        return _answered(asked, arrays)
    return pa.table([pa.array([], t) for t in (pa.int32(), pa.string(), pa.binary(), pa.binary())], names=["slice", "lang", "grams", "h"])


def _with_bands(told: DataFrame, lower: float, upper: float) -> DataFrame:
    """Rows of entropies() with base_failed, entropy, low and high.

    A band lies around the language's median, drawn to that of all texts as if
    PRIOR_DOCS more had it, and reaches lower and upper robust deviations down and up:
    the language's, drawn to those of all texts likewise, for a text of that length; the
    median's own error widens it. Median and deviations are of texts that the models read.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    told = told.withColumn("base_failed", failed).withColumn("entropy", F.col("bits") / F.when(F.col("units") > 0, F.col("units")))
    told = told.withColumn("_scale", F.sqrt(1 / F.when(F.col("units") > 0, F.col("units")) + 1 / LONG))
    good = told.where(~F.col("base_failed") & (F.col("n_symbols") <= MOST_SYMBOLS * F.col("n_words")))
    middle = F.percentile_approx("entropy", 0.5, 10_000)
    whole = good.agg(middle.alias("_all"))
    mids = good.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), middle.alias("_m"))
    langs = told.select("lang").distinct()
    mids = langs.join(mids, "lang", "left").crossJoin(F.broadcast(whole))  # of one row
    n = F.coalesce(F.col("_n"), F.lit(0))
    mids = materialize(mids.select("lang", n.alias("_n"), ((n * F.coalesce("_m", F.lit(0.0)) + PRIOR_DOCS * F.col("_all")) / (n + PRIOR_DOCS)).alias("_mid")), "rule-middles")
    off = join_checked(good, mids, ["lang"], "inner", 100_000).select("lang", ((F.col("entropy") - F.col("_mid")) / F.col("_scale")).alias("_z"))
    off = materialize(off, "rule-offsets")
    spread = F.pow((F.percentile_approx("_z", 0.75, 10_000) - F.percentile_approx("_z", 0.25, 10_000)) / 1.349, F.lit(2.0))
    spreads = mids.join(off.groupBy("lang").agg(spread.alias("_v")), "lang", "left").crossJoin(F.broadcast(off.agg(spread.alias("_w"))))
    wide = F.sqrt((F.col("_n") * F.coalesce("_v", F.lit(0.0)) + PRIOR_SPREAD * F.col("_w")) / (F.col("_n") + PRIOR_SPREAD))
    unsure = F.sqrt(1 + math.pi / 2 / F.greatest(F.col("_n"), F.lit(1)))
    bands = materialize(spreads.select("lang", "_mid", (wide * unsure).alias("_dev")), "rule-bands")
    out = join_checked(told, bands, ["lang"], "inner", 100_000)
    one = F.when(F.col("_scale").isNotNull(), F.greatest(F.col("_dev") * F.col("_scale"), F.lit(LEAST_DEVIATION)))
    return out.withColumn("low", F.col("_mid") - lower * one).withColumn("high", F.col("_mid") + upper * one).drop("_mid", "_dev", "_scale")


def quality_rules(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """Rows (doc_id, lang, the five figures, base_failed, entropy, low, high, kept) of docs (doc_id, lang, text).

    base_failed: fewer than 20 words, or over 30 percent of the words repeat in
    windows of eight. kept: not base_failed, and the mean entropy of a unit in bits
    (the logarithm of perplexity) lies between low and high, which depend on the
    language and the text's length. Copies of a text count once, in the models and in
    the bands. A null language is one of its own. A language with few documents leans on
    the model and the bands of all languages the more, the fewer it has; no number of
    documents is a limit. Where no document at all can be read by a model, there are no
    bands, and the rules alone decide. An empty text has no entropy and no band. Null and empty texts fail. Null ids stay null.
    Repeated rows each give a row; an empty table gives an empty result. Other columns are
    not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("own"), _key(F.col("lang")).alias("lang"), text.alias("text"))
    told = materialize(_with_bands(entropies(slim.select("lang", "text")), lower, upper), "rule-verdicts")
    keyed = slim.select("doc_id", "own", "lang", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    fits = F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(True))
    rows = keyed.join(told, ["lang", "digest"])
    return rows.select("doc_id", F.col("own").alias("lang"), *FIGURES, "base_failed", "entropy", "low", "high", (~F.col("base_failed") & fits).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and perplexity bands over whole documents."""
    rows = quality_rules(table(spark, sf_dir, "documents", "doc_id", "lang", "text"))
    return rows.select("doc_id", *FIGURES, "base_failed", "kept", "entropy")
