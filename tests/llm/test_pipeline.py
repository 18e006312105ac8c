"""The pipeline against its stages done by plain Python, and the queries against their SQL."""

import hashlib
from collections import Counter

import pytest
from compare import duck, run
from test_search import classes, fingerprint, leaks
from tokenizers import Tokenizer

import corpus_pipeline
from tradeframe.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def without_repeats(rows):
    first, split = {}, [(i, t, t.encode().split()) for i, t in sorted(rows)]
    for i, _, w in split:
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    out = []
    for i, t, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                gone[k : k + 20] = [True] * 20
        out.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t))
    return out


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    sample = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = {r["doc_id"] for r in toxicity.toxicity(sample, labels).collect() if r["predicted"]}
    rows = [(i, t) for i, t in rows if i not in toxic]
    prints = [(i, fingerprint(t)) for i, t in rows]
    least = classes(prints)
    rows = [(i, t) for (i, t), (_, p) in zip(rows, prints) if least[p] == i]
    rows = without_repeats(rows)
    rows = [(i, t) for i, t in rows if not any(r[5] for r in leaks([(i, t)], items))]
    library = Tokenizer.from_file(queries.vocabulary_path())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == want
    assert toxic and len(rows) < sample.count()


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, docs, FOLDER)
            assert left.columns == docs.columns and [f.dataType for f in left.schema] == [f.dataType for f in docs.schema]
            assert left.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


def test_a_text_that_loses_words_is_counted_anew(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a\n{passage}", 99), (2, f"b  {passage} c", 99)], "doc_id long, text string, n_chars long")
    assert {tuple(r) for r in corpus_pipeline.without_repeats(spark, docs, FOLDER).collect()} == {(1, f"a\n{passage}", 99), (2, "b c", 3)}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, con, name):
    difference, rows, _ = run(spark, FOLDER, name, queries.QUERIES[name], queries.SQL.get(name), con)
    assert difference is None and rows > 0
