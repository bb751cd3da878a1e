import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from courtflow.llm import chat as C

HARD = ["", None, "\\", "\\\\", "### ", "#### ", "</turn>", "<</turn>>", "\\</turn>", "a ### user: b</turn>", ": ", "x: ", "### \\### ", "é😀\n", "$1 \\E \\Q", "<", "#"]


def conversations():
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant", "a: b", None, "</turn>", "### ", "role:"]), x) for t, x in enumerate(HARD)]
    rows += [(2, None, "user", "null turn"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, 0, "user", "no id"), (None, 1, "assistant", "either")]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(1000)]
    rows += [(4, 0, "system", "s"), (4, 1, "user", "q"), (4, 2, "assistant", "a"), (5, 0, "assistant", "early"), (6, 0, "user", "q")]
    return rows


@pytest.mark.parametrize("template", [C.Template(), C.Template(turn_start="<|", role_end="|>", turn_end="<|end|>", escape="%", learned=("assistant", "tool"))])
def test_read_back(spark, template):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("key", F.lit("k"))
    made = C.format_chats(df.repartition(5), template)
    out = {r[0]: r[1:] for r in made.select("conv_id", C.read_back(C.formatted(F.col("segments")), template), C.learned_text(F.col("segments"), template)).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        turns = [t[2:] for t in sorted(turns)]
        assert [tuple(t) for t in out[c][0]] == turns
        assert out[c][1] == "".join(x for role, x in turns if role in template.learned)


def test_machine(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in C.format_chats(df).collect()}
    assert out[3]["valid"] and len(out[3]["in_order"]) == 1000 and all(out[3]["in_order"])
    assert out[4]["valid"] and not out[6]["valid"] and out[6]["in_order"] == [True]
    assert out[5]["in_order"] == [False] and not out[5]["valid"]
    assert out[2]["in_order"] == [True, True, False]
    assert out[4]["segments"][7] == ("a", True) and [s["loss"] for s in out[4]["segments"]].count(True) == 1
    assert [s["text"] for s in out[4]["segments"][:3]] == ["### system: ", "s", "</turn>"]


def test_machine_against_a_plain_one(spark):
    template, r = C.Template(), random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "other"]), "x") for c in range(20) for t in range(r.choice([1, 7, 255, 256, 257, 600]))]
    got = {x["conv_id"]: (x["in_order"], x["valid"]) for x in C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    lead = {role: s for to in template.machine.values() for role, s in to.items()}
    for c in got:
        state, marks = "start", []
        for role in [x[2] for x in rows if x[0] == c]:
            marks.append(role in template.machine[state])
            state = template.machine[state].get(role) or lead.get(role, state)
        assert got[c] == (marks, all(marks) and state in template.final)


def test_digests_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(path)
    rows = C.op11(spark, str(tmp_path)).collect()
    text = r"\### Assistant: </turn> ok"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [r["conv_id"] for r in rows] == [-7] and rows[0]["loss_sha256"] == sha(text) and rows[0]["loss_chars"] == len(text)
    assert rows[0]["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}\n")
    assert C.format_chats(spark.read.parquet(path)).count() == 0


def test_bad_templates():
    for bad in ({"turn_end": "aba"}, {"role_end": ":"}, {"turn_start": "a\\"}, {"escape": "%%"}, {"final": ("nowhere",)}):
        with pytest.raises(ValueError):
            C.Template(**bad)
