import re
from collections import Counter

from tradeframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def check(docs, rows):
    found = Counter(tuple(r)[:7] for r in quality.quality(docs).collect())
    assert found == Counter((i, *base(t)) for i, t in rows)


def test_counts(sample):
    check(sample, [(r["doc_id"], r["text"]) for r in sample.collect()])


def test_odd_rows(odd_docs, no_docs, texts):
    check(odd_docs, texts)
    assert quality.quality(no_docs).count() == 0


def test_repeats(spark):
    rows = [(1, "a b c a b c d"), (2, "x " * 5), (3, "a b c d a b"), (4, "l\nl\n \n\nm\nl"), (5, "a\x0bb\x0cc\rd\te"), (6, "one two one two one two")]
    check(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string"), rows)


def test_verdicts(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.quality(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0  # clean documents stay
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_native(sample):
    plan = quality.features(sample)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
