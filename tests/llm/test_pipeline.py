"""Each stage of the pipeline against brute force on what its predecessor left."""

import corpus_pipeline
import public_tokenizers as P
from test_maps import check_packed
from test_near_dups import brute
from test_secrets import plain as secrets_of
from test_substrings import words_removed
from tokenizers import Tokenizer

from vertexloom.llm import language
from vertexloom.llm.common import cut, table


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    extra = spark.createDataFrame([(10_000, None, "en", "s", None), (10_001, "1234 + 5", "en", "s", 8), (None, "this is the one and only text of them all", "en", "s", 41)], docs.schema)
    docs, kept = cut(docs.union(extra)), {}
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = texts(docs) if k == 0 else kept, stage(spark, docs, d)
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS, name
        kept = texts(docs) if k < 4 else None
        if k == 0:
            assert before.keys() - kept.keys() >= {10_000, 10_001} and len(kept) > 0.95 * len(before)
            assert all(language.has_letter(x) for x in kept.values())
        if k == 1:
            groups = brute(list(before.items()))
            assert {-1 if i is None else i for i in kept} == {i for i, c in groups if i == c or i == -1}
        if k == 2:
            want = words_removed(list(before.items()))
            assert kept == {i: x if want[i] is None else want[i] for i, x in before.items()}
        if k == 3:
            assert kept.keys() == before.keys() and all((kept[i] == x) == (not secrets_of(x)[4]) for i, x in before.items())
        if k == 4:
            check_packed(docs.collect(), before, Tokenizer.from_file(P.path("byte_bpe_50k.json")))


def test_run(spark):
    """The pipeline's rows are whole pieces of just the texts that the first four stages leave, which test_stages() holds against brute force."""
    d = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, d)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = cut(stage(spark, docs, d))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(text) > 100
    check_packed(rows.collect(), text, Tokenizer.from_file(P.path("byte_bpe_50k.json")))
