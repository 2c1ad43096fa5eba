import numpy as np

import corpus_pipeline
from brute import removed_lines, without
from test_packing import check
from test_simhash import plain_components, plain_fingerprint
from tidescore.llm import language
from tidescore.llm.secrets import _words, find_secrets, redacted

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, documents_small):
    docs = documents_small
    for name, stage in corpus_pipeline.STAGES:
        before = {row.doc_id: row for row in docs.collect()}
        result = stage(spark, docs, SF_DIR)
        if name == "best-fit packing":
            check(result.collect(), {doc_id: row.text for doc_id, row in before.items()})
            break
        assert result.dtypes == docs.dtypes
        docs = spark.createDataFrame(result.collect(), result.schema)
        after = {row.doc_id: row for row in docs.collect()}
        texts = {doc_id: row.text for doc_id, row in before.items()}
        if name == "language ID":
            model = language.fit_language(language.training_rows(spark.createDataFrame(list(before.values()), result.schema)))
            assert after == {doc_id: row for doc_id, row in before.items() if model.predict(row.text)[2]}
            assert len(after) >= 0.98 * len(before)
            continue
        if name == "line dedup":
            gone = removed_lines(texts)
            expected = {doc_id: without(text, gone.get(doc_id, [])) for doc_id, text in texts.items()}
        elif name == "SimHash near-dedup":
            groups = plain_components(list(texts), [plain_fingerprint(text) for text in texts.values()])
            expected = {doc_id: texts[doc_id] for doc_id in set(groups.values())}
        else:
            expected = {doc_id: redacted(text, find_secrets(text, _words(None))[0], "[secret]")
                        for doc_id, text in texts.items()}
        assert {doc_id: row.text for doc_id, row in after.items()} == expected
        if name != "SimHash near-dedup":
            assert all(row.n_chars == len(row.text) for row in after.values())


def test_run_and_registration(spark):
    import __spark_entry__

    found = __spark_entry__.queries()["pipeline"](spark, SF_DIR)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(name[2:].split("_")[0]) for name in __spark_entry__.queries() if name.startswith("op")) == list(
        np.arange(1, 14))


def test_odd_rows(spark, docs_of, odd):
    docs = docs_of([*odd, (None, "the and of to in " * 20), (None, None)])
    for empty in (docs, docs.limit(0)):
        rows = empty
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF_DIR)
        rows.count()
