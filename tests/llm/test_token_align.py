"""The alignment against a plain version: tokenizers called one text at a time,
offsets and links by loops over all token pairs."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colsense.llm import token_align as ta

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "One"), (9004, "One"), (None, "a null id, with text of its own"), (9005, "x " * 700 + "very" * 90),
       (9006, "É Ü ß 12 — ok\r\nline"), (9007, "<|endoftext|> don't <s> <0x41> <unk>"), (9008, "a▁b"), (9009, "中文🙂 \u0000 ​ é"), (9010, "  two  spaces  ")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 600")
    return real.unionByName(odd).withColumn("chunk", F.lit("x")).withColumn("links", F.lit(1)).withColumn("n", F.lit(None).cast("int")).cache()


def _plain(rows):
    a_path, b_path = (public_tokenizers.path(x) for x in (ta.A_FILE, ta.B_FILE))
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    char = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    out, count = [], Counter()
    for i, text in rows:
        pieces = [[], []]
        if text:
            pieces[0] = [(x, bytes(char[c] for c in a.id_to_token(x))) for x in a.encode(" " + text, add_special_tokens=False).ids]
            pieces[1] = [(x, bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode()) for x in b.encode(text)]
            if any(b"".join(x for _, x in p) != b" " + text.encode() for p in pieces):
                pieces = [[], []]
        spans = []
        for p in pieces:
            at, s = 0, []
            for x, raw in p:
                s.append((at, at + len(raw), x))
                at += len(raw)
            spans.append(s)
        links = [(x, y) for f, t, x in spans[0] for g, u, y in spans[1] if max(f, g) < min(t, u)]
        cuts = sorted({t for _, t, _ in spans[0]} & {t for _, t, _ in spans[1]})
        shown_groups = ";".join("|".join(",".join(str(x) for _, t, x in s if low < t <= high) for s in spans) for low, high in zip([0, *cuts], cuts))
        count.update(links)
        out.append((i, spans, links, cuts, hashlib.sha256(shown_groups.encode()).hexdigest() if cuts else ""))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, len(s[0]), len(s[1]), len(cuts), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest)
            for i, s, links, cuts, digest in out], count


def _key(r):
    return tuple((x is None, x) for x in r)


def test_against_loops(docs, monkeypatch):
    want, count = _plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r[0] for r in want if r[1] == 0} >= {9001, 9002, 9008}
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for chunk, part, at_once in ((ta.CHUNK_BYTES, ta.PAIRS_A_ROW, ta.SLICE_BYTES), (3000, 7, 500)):  # one chunk a task, and many
        monkeypatch.setattr(ta, "SLICE_BYTES", at_once)
        monkeypatch.setattr(ta, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(ta, "PAIRS_A_ROW", part)
        out = ta.align_documents(docs, spans=True)
        got = [tuple(r) for r in out.scored().select(*columns).collect()]
        assert sorted(got, key=_key) == sorted(want, key=_key)
        pairs = {(r.pair // out.b_size, r.pair % out.b_size): r["n"] for r in out.pairs.collect()}
        assert pairs == count
    spans = {r.doc_id: list(r.cuts) for r in out.documents.where("doc_id = 9004").collect()}
    assert spans == {9004: [4]}


def test_ranks_give_the_files_ids():
    import random
    tok = ta.Tokenizers(*(public_tokenizers.path(x) for x in (ta.A_FILE, ta.B_FILE)))
    assert tok.ranked
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\r\n", "\t", "a", "B", "é", "ß", "中", "🙂", " ", "▁", "́", "1", "23", "'s", "'LL", "-", "...", "<|endoftext|>", "\x00", "　", "Ⅷ", "​", "word", "The"]
    texts = [" " + "".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000)]
    assert [tok.ranked.encode_ordinary(t) for t in texts] == [x.ids for x in tok.a.encode_batch(texts, add_special_tokens=False)]


def test_merges_out_of_order_use_the_file(tmp_path):
    with open(public_tokenizers.path(ta.A_FILE), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"].reverse()
    (tmp_path / "other.json").write_text(json.dumps(spec))
    tok = ta.Tokenizers(str(tmp_path / "other.json"), public_tokenizers.path(ta.B_FILE))
    assert tok.ranked is None and len(tok.encode(["some text"])[0]) == 1


def test_empty(docs):
    assert ta.align_documents(docs.limit(0)).scored().count() == 0
    assert [tuple(r) for r in ta.align_documents(docs.where("text is null")).scored().collect()] == [(9001, 0, 0, 0, 0, 0, 0, "")]
