import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ODD_TEXTS, prose
from tidewell.llm import mixing


def documents(spark, rnd):
    texts = [prose(rnd, rnd.randrange(30, 90)) for _ in range(80)]
    rows = [(i, t, "xx", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100, texts[0], "xx", "s0"), (101, texts[1] + " end.", "xx", "s1"), (102, texts[2] + " You are a stupid idiot, I will kill you.", "xx", "s2")]
    rows += [(200 + i, t, None, None) for i, t in enumerate(ODD_TEXTS)]
    return texts, rows


def stages(spark, docs, sf_dir, tmp_path):
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        out.append(docs)
    return out


def test_stages(spark, rnd, tmp_path):
    texts, rows = documents(spark, rnd)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    toxic, rules, near, mixed, encoded = stages(spark, docs, str(tmp_path), tmp_path)
    for stage in (toxic, rules, near, mixed):
        assert stage.columns == docs.columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in (toxic, rules, near, mixed)]
    assert ids[0] == {r[0] for r in rows} - {102}
    assert ids[1] == {*range(80), 100, 101}
    assert ids[2] == set(range(80))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(near).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r["ids"] == sp.encode(texts[r["doc_id"]]) for r in encoded.collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == sorted(r["doc_id"] for r in encoded.select("doc_id").collect())


def test_rows_without_ids_and_clashing_columns(spark, rnd, tmp_path):
    text = prose(rnd, 60)
    rows = [(None, text, "xx", "a", "k"), (None, prose(rnd, 60), "xx", "a", "k"), (1, prose(rnd, 60), "xx", None, "k"), (1, prose(rnd, 60), "xx", "b", "k"), (1, text, None, "b", None), (2, "", "xx", "a", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row string").withColumn("score", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("entropy", F.lit(3))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic, rules, near, mixed, encoded = stages(spark, docs, str(tmp_path), tmp_path)
    assert (toxic.count(), rules.count(), near.count()) == (6, 5, 4)
    assert near.columns == docs.columns and near.where(F.col("text") == text).count() == 1
    assert encoded.count() == mixed.count()
    empty = stages(spark, docs.limit(0), str(tmp_path), tmp_path / "empty")
    assert [x.count() for x in empty] == [0] * 5
