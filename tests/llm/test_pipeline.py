"""The pipeline's stages, each on what the one before kept, against brute force."""

import corpus_pipeline
from colsense.llm import quality
from colsense.llm.common import stage, table

from test_operators import SF, _set


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for _, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, SF))
        kept.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert all(d.columns == columns for d in kept[:-1])
    good = {r.doc_id for r in quality.op9_quality_classifier(spark, SF).where("predicted = 1").collect()}
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in kept]
    assert sorted(ids[0]) == sorted(good) and sorted(ids[1]) == sorted(ids[0])
    sets = {r.doc_id: _set(r.text) for r in kept[1].collect()}
    order = sorted(sets)

    def linked(a, b):
        return sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    near = {i: {j for j in order if j != i and linked(i, j)} for i in order}
    seen, want = set(), []
    for i in order:  # the smallest id of each component
        if i not in seen:
            want.append(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    assert sorted(ids[2]) == want
    assert set(ids[3]) <= set(ids[2]) and 0 < len(ids[3])
    assert set(ids[4]) == set(ids[3])


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, SF))
    assert docs.count() == 0


def test_rows_with_null_and_repeated_ids_are_judged_each_for_itself(spark):
    item = table(spark, SF, "benchmark").where("length(text) > 120").first().text
    docs = table(spark, SF, "documents").where("doc_id is not null").limit(1)
    cols = docs.columns
    clean = [" ".join(f"{a}{k}x{i}" for i in range(60)) for k, a in enumerate("abcdefgh")]
    near = clean[6] + " end"

    def with_texts(rows):
        made = spark.createDataFrame(rows, "doc_id long, text string")
        return made.crossJoin(docs.drop("doc_id", "text")).select(*cols)
    rows = [(None, item), (None, clean[0]), (None, clean[1]), (7, item), (7, clean[2]), (7, clean[2]), (8, clean[3])]
    left = corpus_pipeline.decontaminate(spark, with_texts(rows), SF)
    assert left.columns == cols
    assert sorted(r.text for r in left.collect()) == sorted(t for _, t in rows if t != item)
    rows = [(None, clean[0]), (None, clean[0] + " end"), (None, clean[1]), (None, clean[6]), (5, near), (9, clean[2]), (9, clean[2]), (9, clean[3]), (4, clean[3] + " end"), (None, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard(spark, with_texts(rows), SF).collect()]
    assert len([g for g in got if g in rows[:2]]) == 1  # a group of null ids only
    key = lambda g: (g[0] or 0, g[1] or "")
    assert sorted((g for g in got if g not in rows[:2]), key=key) == sorted([(None, clean[1]), (5, near), (9, clean[2]), (4, clean[3] + " end"), (None, None)], key=key)
