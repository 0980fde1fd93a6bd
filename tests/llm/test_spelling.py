"""Spelling variants against all pairs of words, compared letter by letter."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colsense.llm import spelling as sp

SF = "/root/testdata/sf0.001"


def _one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _grouped(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and _one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= sp.RATIO * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def _counted(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def _rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.fixture(scope="module")
def words():
    """Words of a few letters, so that many are near each other, with chains of
    forms, ties, long words, repeated letters and letters beyond ASCII."""
    rng = random.Random(11)
    out = {"".join(rng.choices("abé", k=rng.randint(6, 9))): rng.choice([5, 5, 30, 200, 1000]) for _ in range(500)}
    long = "ab" * 900
    out |= {long: 5, long[:1000] + "ÿ" + long[1000:]: 25, long[:-1]: 6, "x" + long: 7, "aaaaaa": 9, "aaaaaaa": 46, "aaaaaaaa": 300}
    out |= {w: 5 for w in ("colour", "color.", "çolour", "ccolour", "olourr")}
    return out


def test_near_words_against_all_pairs(spark, words, monkeypatch):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = _grouped(words)
    assert max(r[4] for r in want) > 5 and any(r[2] not in (r[0], r[1]) for r in want)
    got = _rows(sp.spelling_forms(df))
    assert len(got) == len(want) and set(got) == want
    # every bucket cut into tiles, many blocks
    monkeypatch.setattr(sp, "TILE_LETTERS", 40)
    monkeypatch.setattr(sp, "BLOCK_LETTERS", 300)
    monkeypatch.setattr(sp, "TOGETHER", 7)
    got = _rows(sp.spelling_forms(df))
    assert len(got) == len(want) and set(got) == want


def test_whole_query(spark, monkeypatch):
    odd = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "Colour " * 40), (9004, "Colour " * 40), (None, "coLour ColourÀ ÀÀÀÀÀÀ×÷ " * 300),
           (9005, "color " * 30_000), (9006, "straße—straßen Straße strasse ŒUVRES œuvres " * 6), (9007, "colo1ur snake_case_words " * 9), (9008, "ab" * 40_000)]
    docs = (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
            .withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("block", F.lit(None).cast("string")).cache())
    monkeypatch.setattr(sp, "HELD_WORDS", 50)
    counts = _counted([(r.doc_id, r.text) for r in docs.collect()])
    got = _rows(sp.spelling_forms(sp.word_counts(docs)))
    assert len(got) == len(counts) and set(got) == _grouped(counts)


def test_no_words(spark):
    none = spark.createDataFrame([(1, None), (2, "five5 words")], "doc_id long, text string")
    assert sp.spelling_forms(sp.word_counts(none)).count() == 0
    assert sp.spelling_forms(sp.word_counts(none.limit(0))).count() == 0
