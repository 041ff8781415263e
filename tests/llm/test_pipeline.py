"""The pipeline's stages against brute force on a small corpus."""

import brute
from conftest import prose

import corpus_pipeline
from shelfscan.llm.common import staged


def test_stages(spark, tmp_path):
    item = prose(77, 20)
    texts = {i: prose(i, 60 + i) for i in range(1, 40)}
    texts[40], texts[41] = texts[3], texts[4] + " tail"
    texts[42] = prose(300, 30) + " " + item + " " + prose(301, 10)
    texts[43], texts[44] = "", None
    texts[45] = prose(302, 50) + " write to me@mail.example.com or +1 (743) 555-3824"
    rows = [(i, t, "en", f"src{i % 2}", len(t or ""), "x") for i, t in texts.items()] + [(None, prose(303, 70), "en", "src0", 1, "y"), (45, texts[45], "en", "src1", 1, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, str(tmp_path)), name)
        seen[name] = out
        if name != "mixing":
            assert out.columns == docs.columns
        docs = out
    ids = {name: sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda x: (x is None, x)) for name, out in seen.items() if name != "mixing"}
    assert ids["language"] == sorted([*range(1, 43), 45, 45]) + [None]
    copies = {i for i, (_, c, _) in brute.op7([(i, t) for i, t in texts.items() if t]).items() if c != i}
    assert copies == {40, 41}
    assert ids["near_duplicates"] == [i for i in [*range(1, 43), 45] if i not in copies] + [None]
    assert ids["decontamination"] == [i for i in ids["near_duplicates"] if i != 42]
    text = {r.doc_id: (r.text, r.n_chars) for r in seen["personal_data"].collect()}
    assert text[45][0].endswith("write to [EMAIL] or [PHONE]") and text[45][1] == len(text[45][0]) and text[5][0] == texts[5]
    mix = seen["mixing"].collect()
    assert mix and all(0 <= r.last_tokens <= r.tokens for r in mix)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mix)


def test_texts_that_share_an_id(spark, tmp_path):
    """No text is lost for another one under its ``doc_id``: each is judged by itself."""
    item = prose(77, 20)
    a, b, c = (prose(i, 60) for i in (1, 2, 3))
    rows = [(1, a), (1, b), (1, a), (2, c), (2, a + " tail"), (3, prose(4, 40) + " " + item), (3, prose(5, 60)), (4, "!!! ..."), (4, prose(6, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def texts(stage):
        return sorted((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect())

    assert texts(corpus_pipeline.keep_known_languages) == sorted(r for r in rows if r != (4, "!!! ..."))
    once = texts(corpus_pipeline.keep_one_of_each)
    assert len(once) == 7 and len({a, a + " tail"} & {t for _, t in once}) == 1
    assert {t for _, t in once} - {a, a + " tail"} == {t for _, t in rows} - {a, a + " tail"}
    assert texts(corpus_pipeline.drop_benchmark_passages) == sorted(r for r in rows if item not in r[1])
