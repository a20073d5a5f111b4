"""The pipeline: every stage against what its operator must have decided."""

from __future__ import annotations

import corpus_pipeline
from quire.llm import pieces, quality


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, small_dir).collect(), stage(spark, docs, small_dir).schema)
        kept[name] = (before, docs.collect())
    before, after = kept["quality classifier"]
    scores = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(before), quality.train(spark.createDataFrame(before), labels)).collect()}
    assert {r.doc_id for r in after} == {i for i, p in scores.items() if p >= 0.3}
    before, after = kept["line dedup"]
    first = {}
    for r in before:
        for line in r.text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
            if len(key) >= 10:
                first.setdefault(key, set()).add(r.doc_id)

    def stays(i, line):
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return len(first.get(key, ())) < 2 or min(first[key]) == i

    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if stays(r.doc_id, x)) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    before, after = kept["n-gram Jaccard join"]
    from tests.llm.test_text_models import brute, words

    classes = brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({classes[tuple(words(r.text.lower()))][0] for r in before})
    before, after = kept["mixing sources"]
    size = sum(len(words(r.text)) for r in before)
    assert abs(sum(len(words(r.text)) for r in after) - 1.5 * size) <= 0.1 * size
    before, after = kept["SentencePiece encoding"]
    assert len(before) == len(after)
    library = __import__("sentencepiece").SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in before}
    assert all(list(r.ids) == library.encode(text[r.doc_id]) for r in after)
    assert pieces.public_model().kind == pieces.BPE


def test_run(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).count() > 100


def test_different_texts_under_null_and_repeated_ids_stay(spark):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [(None, own(0)), (None, own(1)), (None, own(1)), (3, own(2)), (3, own(3)), (5, own(3)), (None, own(2)), (7, own(4)), (7, own(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, own(0)), (None, own(1)), (3, own(2)), (3, own(3)), (7, own(4))], key=str)


ODD = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped string, source_size int, rest string, key string, size string, copies int, `a.b` int"


def test_odd_documents_pass_every_stage(spark, small_dir):
    """Null ids and texts, one id with two texts, repeated rows, clashing columns, a very long text, no rows."""
    own = lambda k: " ".join(f"word{k}x{i} of" for i in range(40))
    texts = [(None, own(0)), (None, own(1)), (1, own(2)), (1, own(3)), (2, own(4)), (2, own(4)), (3, None), (4, ""), (None, None), (5, "short"), (6, "\n".join(f"{own(k)} line" for k in range(10, 400)))]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 3}", 7, 1, "x", 2, "r", "k", "s", 3, k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, ODD)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, small_dir)
        assert out.columns == docs.columns and out.schema["a.b"].dataType == docs.schema["a.b"].dataType
        assert stage(spark, docs.limit(0), small_dir).count() == 0
    assert corpus_pipeline.keep_quality(spark, docs, small_dir).columns == docs.columns
    assert corpus_pipeline.keep_quality(spark, docs.limit(0), small_dir).count() == 0
    lines = {r["a.b"]: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, small_dir).collect()}
    assert len(lines) == len(rows) and lines[6].text == "" and all(r.n_chars == len(r.text) and (r.n_lines, r.n_dropped) == (1, "x") for r in lines.values())
    one = [r["a.b"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, small_dir).collect()]
    # both copies of a row are one row; texts without words are one group
    assert sorted(one) in ([0, 1, 2, 3, 4, 6, 9, 10], [0, 1, 2, 3, 5, 6, 9, 10])
    assert corpus_pipeline.encode_pieces(spark, docs, small_dir).count() == len(rows)
    assert corpus_pipeline.encode_pieces(spark, docs.limit(0), small_dir).count() == 0
