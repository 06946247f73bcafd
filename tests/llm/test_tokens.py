import hashlib
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_TEXTS, prose
from tidewell.llm import piece_bpe, token_counts, token_tables

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
MORE = ["don't <|endoftext|> İstanbul ǅ ﬁ", "<s> </s> <unk> ▁ ▁▁ <0x41>", "a  b   c    d" + " " * 70 + "e", "\r\n\ttabs\x85 and lines", "aaaaaaaaaaaaaaaaaaaaaaaa", "ÀÉÎÕÜ ßẞ straße", "x" * 3000, "1234567890 3.14 12:30", "é combining", "퟿"]


def rows_of(rnd):
    texts = [*ODD_TEXTS, *MORE, *(prose(rnd, rnd.randrange(1, 80)) for _ in range(30)), *("".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x500), rnd.randrange(0x3040, 0x3100)])) for _ in range(60)) for _ in range(30))]
    return [(i * 3 - 20, t) for i, t in enumerate(texts)]


def test_pieces_equal_the_library(spark, rnd):
    rows = rows_of(rnd)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in piece_bpe.round_trip_digests(docs, PIECES, with_ids=True).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), t
    encoded = piece_bpe.encode_documents(docs, PIECES)
    decoded = {r["doc_id"]: r["text"] for r in piece_bpe.decode_documents(encoded, PIECES).collect()}
    assert all(decoded[i] == sp.decode(sp.encode(t or "")) for i, t in rows)
    assert piece_bpe.round_trip_digests(docs.limit(0), PIECES).collect() == []


def test_long_texts_and_clashing_names(spark, rnd, tmp_path):
    """A text beyond LONG_TEXT is cut into words in pieces; long words aren't remembered."""
    long = prose(rnd, 4000) * 60 + " " + "y" * 20_000
    assert len(long) > piece_bpe.LONG_TEXT
    rows = [(1, long), (2, "short"), (3, long[:-5]), (None, "short " + "z" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("ids", "n_tokens", "part", "digest", "_key", "start", "shard", "n_bytes"):
        docs = docs.withColumn(name, F.lit("clash"))
    sp, tokenizer = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    for r in piece_bpe.round_trip_digests(docs, PIECES, with_ids=True).collect():
        text = dict(rows)[r["doc_id"]]
        ids = sp.encode(text)
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PIECES, f"file://{tmp_path}/cache").collect()} == {i: len(sp.encode(t)) for i, t in rows}
    token_tables.write_shards(docs, f"file://{tmp_path}/t", WORDS)
    got = token_tables.with_starts(token_tables.read_shards(spark, f"file://{tmp_path}/t")).collect()
    assert {r["doc_id"]: r["ids"][:-1] for r in got} == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_tables_round_trip(spark, rnd, tmp_path):
    rows = [*rows_of(rnd), (None, "no id"), (5, "twice"), (5, "twice")]
    path = f"file://{tmp_path}/t"
    token_tables.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, WORDS, shard_text_bytes=4000)
    got = token_tables.with_starts(token_tables.read_shards(spark, path)).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted(((d is not None, d or 0), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids"]) for r in got) == want
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(d for d, _ in rows if d is not None)
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert len({r["shard"] for r in got}) > 2
    found = token_tables.look_up(spark, path, [5, rows[3][0], 10**9]).collect()
    assert sorted(r["doc_id"] for r in found) == sorted([5, 5, rows[3][0]])


def test_tables_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    token_tables.write_shards(spark.createDataFrame([], "doc_id long, text string"), path, WORDS)
    assert token_tables.with_starts(token_tables.read_shards(spark, path)).collect() == []


def test_damage_is_noticed():
    writer = token_tables.ShardWriter(0, 2)
    parts = [*writer.add(token_tables.key_of(5), np.array([1, 2, 3], "<u2")), *writer.finish()]
    data = bytearray(b"".join(p + b"\n" for p in parts))
    assert token_tables.Shard(bytes(data)).get(5)[0].tolist() == [1, 2, 3]
    data[3] ^= 1
    try:
        list(token_tables.Shard(bytes(data)))
    except ValueError:
        return
    raise AssertionError


def test_only_misses_are_encoded(spark, rnd, tmp_path, monkeypatch):
    """A hot content, texts without id and ids that repeat: each distinct content that the cache lacks is encoded once."""
    encoded, real = [], token_counts._encode

    def spy(path):
        run, log = real(path), f"{tmp_path}/{len(encoded)}"
        encoded.append(log)

        def watched(batches):
            def told(rows):
                for batch in rows:
                    with open(log, "a") as file:
                        file.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()))
                    yield batch

            yield from run(told(batches))

        return watched

    monkeypatch.setattr(token_counts, "_encode", spy)
    first = [(i, "hot text") for i in range(50)] + [(None, f"no id {i}") for i in range(20)] + [(7, f"one id {i}") for i in range(20)]
    more = first + [(i, "hot text") for i in range(50, 90)] + [(None, "no id new"), (7, "one id new"), (8, "one id new")]
    for rows, fresh in ((first, 41), (more, 2), (more, 0)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit("k"))
        assert token_counts.count_tokens(docs, PIECES, f"file://{tmp_path}/cache").count() == len(rows)
        try:
            with open(encoded[-1]) as file:
                lines = file.read().splitlines()
        except FileNotFoundError:
            lines = []
        assert len(lines) == len(set(lines)) == fresh


def test_counts_and_cache(spark, rnd, tmp_path):
    rows = [*rows_of(rnd), (None, "x y"), (7, "same"), (7, "same"), (8, "same"), (10**6, "word " * 5000)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((repr(d), len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in rows)
    for _ in range(2):
        got = token_counts.count_tokens(docs, PIECES, f"file://{tmp_path}/cache").collect()
        assert sorted((repr(r[0]), *r[1:]) for r in got) == want
    stored = spark.read.parquet(f"file://{tmp_path}/cache")
    assert stored.count() == len({t or "" for _, t in rows})
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})
    assert token_counts.count_tokens(docs.limit(0), PIECES, f"file://{tmp_path}/cache").collect() == []
