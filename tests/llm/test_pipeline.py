"""The corpus pipeline, stage by stage, on planted cases."""

import random

import pytest

import corpus_pipeline
from plumbline.llm.common import keep


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    texts = ["\n".join(line() for _ in range(10)) for _ in range(120)]
    for i in range(0, 120, 6):
        texts[i] = "\n".join(" ".join(word() + "%%%" for _ in range(12)) for _ in range(10))
    shared, item = line(60), line(14)
    for i in (1, 2, 3):
        texts[i] += "\n" + shared
    copy = texts[7].split()
    copy[40] = "changed"
    texts += [" ".join(copy).replace("\n", " "), texts[8].replace("\n", " ") + " " + item, None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, shared


def test_stages(spark, folder):
    path, texts, shared = folder
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(stages) == 5
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}

    def apply(name, docs):
        out = keep(stages[name](spark, docs, path), "t")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        return out

    judged = apply("quality classifier", docs)
    junk = {i for i in range(0, 120, 6)}
    assert not ids(judged) & junk and set(range(120)) - junk <= ids(judged)
    lines = apply("line dedup", judged)
    holders = [r.doc_id for r in lines.collect() if shared in (r.text or "").split("\n")]
    assert holders == [1]
    near = apply("SimHash near-dedup", judged)
    assert 7 in ids(near) and 120 not in ids(near)
    clean = apply("benchmark decontamination", judged)
    assert ids(judged) - ids(clean) == {121}
    mixed = apply("mixing sources to target weights", clean)
    assert mixed.count() and all(0 < r.taken <= 2 * r.size for r in mixed.collect())


def test_run(spark, folder):
    path, *_ = folder
    first, second = (sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, path).collect()) for _ in range(2))
    assert first and first == second
