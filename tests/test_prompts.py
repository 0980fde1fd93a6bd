"""Prompt parts and requests on a small corpus: table modes, example columns,
vocabularies for each instance, too few instances."""

import pytest
from pyspark.sql import functions as F

from colsense.operators import prompts, sample
from colsense.operators.prompts import PromptSettings

ROWS = [(t, r, [f"v{t}.{r}.{c}" if (t + r + c) % 4 else None for c in range(3 + t)]) for t in range(5) for r in range(1 + t)]
TABLES = [(t, "" if t == 3 else f"name{t}", [f"h{c}" for c in range(3 + t)], [None if (t + c) % 3 == 0 or t == 1 else f"type{c}" for c in range(3 + t)])
          for t in range(5)]


def _vocabulary():
    return F.array(*[F.lit(f"type{c}") for c in range(9)])


def _inputs(spark):
    return (spark.createDataFrame(ROWS, "table_id long, row_idx int, cells array<string>"),
            spark.createDataFrame(TABLES, "table_id long, table_name string, headers array<string>, true_types array<string>"))


def _order(t, rows):
    import hashlib
    return sorted(rows, key=lambda r: (int(hashlib.md5(f"20260311|{t}|{r}".encode()).hexdigest()[:8], 16), r))[:3]


@pytest.mark.parametrize("mode", ["csv", "key_value"])
def test_parts(spark, mode):
    parts = {r.table_id: r for r in prompts.prompt_parts(*_inputs(spark), PromptSettings(mode=mode, example_columns=None)).collect()}
    assert set(parts) == {0, 2, 3, 4}  # table 1 has no label
    cells = {(t, r): c for t, r, c in ROWS}
    for t, name, heads, types in TABLES:
        if t == 1:
            continue
        known = [i for i, x in enumerate(types) if x]
        for text, at in ((parts[t].table_text, range(len(heads))), (parts[t].ex_text, known)):
            lines = []
            for r in _order(t, range(1 + t)):
                if mode == "csv":
                    lines.append(",".join(cells[t, r][i] or "" for i in at))
                else:
                    lines.append(", ".join(f"{heads[i]}: {cells[t, r][i] or 'nan'}" for i in at))
            body = "\n".join([",".join(heads[i] for i in at), *lines, ""]) if mode == "csv" else "\n".join(lines)
            assert text == (name or "{{table_name}}") + "\n" + body
        assert parts[t].ex_types == "[" + ", ".join(f'"{types[i]}"' for i in known) + "]"


def test_example_columns_and_vocabulary(spark):
    s = PromptSettings(examples=2, example_columns=2, instance_vocabulary=6, mode="markdown")
    parts = prompts.prompt_parts(*_inputs(spark), s)
    assert all(r.ex_types.count("type") == 2 and r.ex_text.split("\n")[1].count("|") == 3 for r in parts.collect())
    labels = {t: {x for x in types if x} for t, _, _, types in TABLES}
    for r in prompts.chat_requests(parts, _vocabulary(), s).collect():
        assert [m.role for m in r.messages] == ["user", "user", "assistant", "user", "assistant", "user"]
        shown = r.messages[0].content.split(": ", 1)[1]
        listed = [x.strip('"') for x in shown.strip("[]").split(", ")]
        assert listed == sorted(set(listed)) and set(listed) >= labels[r.request_id]
        assert len(listed) >= 6 and (len(listed) == 6 or len(labels[r.request_id]) > 2)
        assert r.max_tokens > 100


def test_too_few_other_instances(spark):
    one = spark.createDataFrame([(7, 0)], "table_id long, ix long")
    with pytest.raises(Exception, match="1 examples wanted, other instances: 0"):
        sample.sample_examples(one, 1, 1).collect()
    three = spark.createDataFrame([(i, i) for i in range(3)], "table_id long, ix long")
    with pytest.raises(Exception, match="3 examples wanted, other instances: 2"):
        sample.sample_examples(three, 3, 1).collect()
    assert sample.sample_examples(one, 0, 1).collect() == [] == sample.sample_examples(one.limit(0), 2, 1).collect()
    got = sample.sample_examples(three, 2, 1).collect()
    assert sorted((r.table_id, r.example_id) for r in got) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_candidates_walk_a_permutation(spark):
    for n, size in ((1, 5), (9, 0), (9, 4), (9, 9), (9, 20), (500, 30)):
        vocab = [f"t{i:03d}" for i in range(n)]
        df = spark.createDataFrame([(i, [f"t{j % n:03d}" for j in range(i, i + 3)] + [None, "own"]) for i in range(40)], "table_id long, labels array<string>")
        out = sample.candidate_vocabulary(df, F.array(*[F.lit(x) for x in vocab]), size, 3).collect()
        drawn = set()
        for r in out:
            own = {x for x in r.labels if x}
            assert r.candidates == sorted(set(r.candidates)) and set(r.candidates) >= own and set(r.candidates) - own <= set(vocab)
            assert len(r.candidates) == max(len(own), min(size, len(own | set(vocab))))
            drawn |= set(r.candidates) - own
        assert n < 500 or len(drawn) > 400  # rows walk differently
