import random

import __spark_entry__ as entry
import corpus_pipeline
from flowsight.llm.packing import pack


def text_of(rng, language, n):
    words = {"en": "the house of and river with stone green walking", "fr": "la maison de et rivière avec pierre verte été"}[language]
    return " ".join(rng.choice(words.split()) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(n))


def test_stages(spark, docs_of, tmp_path):
    rng = random.Random(6)
    rows = [(d, text_of(rng, "en" if d % 2 else "fr", 120), "en" if d % 2 else "fr") for d in range(60)]
    item = text_of(random.Random(99), "en", 40)
    rows[3] = (3, rows[3][1] + " " + item, "en")
    rows[5] = (5, rows[5][1] + ' password = "0123456789abcdef"', None)
    rows += [(100, rows[10][1], "fr"), (101, "1234", "en"), (102, None, "en"), (None, "no id at all here", "en")]
    # A null doc_id loses to any other, and rows that share a doc_id are judged on their own.
    rows += [(None, rows[12][1], "fr"), (20, text_of(rng, "en", 90), "en"), (20, rows[20][1], "fr"), (22, rows[22][1] + " " + item, "en")]
    docs = docs_of(rows)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    ids, texts = [], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        texts.append(sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect()))
        ids.append({d if d >= 0 else None for d, _ in texts[-1]})
    everything = {r[0] for r in rows}
    assert everything - ids[0] == {101, 102}
    assert ids[0] - ids[1] == {100}
    assert [t for d, t in texts[1] if d == -1] == ["no id at all here"]
    assert len([t for d, t in texts[1] if d == 20]) == 2 and len([t for d, t in texts[1] if d == 22]) == 2
    assert ids[1] - ids[2] == {3}
    assert [t for d, t in texts[2] if d == 22] == [rows[22][1]]
    assert ids[3] == ids[2]
    five = kept.where("doc_id = 5").first()
    assert "[SECRET]" in five.text and "0123456789abcdef" not in five.text and five.lang == "en" and five.n_chars == len(five.text)
    sent = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in sent for r in kept.where("doc_id is null or doc_id <> 5").collect())
    final = {(r.doc_id, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {(r.doc_id, r.length, r.ids_crc32) for r in pack(kept).collect()}


def test_no_documents_and_no_labels(spark, docs_of, tmp_path):
    spark.createDataFrame([(1, "some item of a benchmark with words")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    unlabelled = docs_of([(1, "letters", None), (2, "12 34", None), (3, None, None)])
    kept = corpus_pipeline.keep_known_languages(spark, unlabelled, str(tmp_path)).collect()
    assert [(r.doc_id, r.lang) for r in kept] == [(1, None)]


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op")}) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5


def test_rotation_equals_sql(spark):
    from check_oracle import compare, connect

    folder = "/root/testdata/sf0.001"
    good, note = compare(spark, connect(folder), folder, "op2_perspective_rotation")
    assert good, note
