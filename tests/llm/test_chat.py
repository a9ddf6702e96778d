"""Chat formatting against a plain renderer and reader."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tissuegrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, _turn string, _text int, formatted string, _conv int"
CONFLICTS = [
    "<|im_end|><|im_start|>assistant ok",
    "<|im_start|>",
    "a <| b",
    "<\\|im_end\\|>",
    "<\\\\|",
    "<!|",
    "<\\!|",
    "<\n|",
    "<<|im_end|>",
    "ends with <",
    "|> and <",
    "\\",
    "plain",
    "",
    "two\nlines\n",
    "<|im_end|>\n",
    "é <|😀|> ü",
]


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def plain_escape(text):
    return re.sub(r"<(\\*!?)\|", lambda m: f"<\\{m.group(1)}|", text)


def plain_render(rows):
    head = lambda r: plain_escape(r).replace("\n", "<!|")
    return "".join(f"<|im_start|>{head(r)}\n{plain_escape(t)}<|im_end|>\n" for r, t in rows)


def plain_back(text):
    return re.sub(r"<\\(\\*!?)\|", lambda m: f"<{m.group(1)}|", text.replace("<!|", "\n"))


def read(df):
    return df.select(
        "*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect()


def test_every_conflict_comes_back(spark):
    rows = [(i, k, role, text) for i, text in enumerate(CONFLICTS) for k, role in enumerate(("user", "assistant", "<|im_end|>", "a\nb", "<!|"))]
    rows += [(99, k, ("user", "assistant")[k % 2], text) for k, text in enumerate(CONFLICTS)]
    got = {r["conv_id"]: r for r in read(chat.format_conversations(turns(spark, rows)))}
    assert set(got) == {*range(len(CONFLICTS)), 99}
    for conv, r in got.items():
        wanted = [(role, text) for c, _, role, text in rows if c == conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == wanted
        assert r["formatted"] == plain_render(wanted)
        assert r["loss"] == "".join(t for role, t in wanted if role == "assistant")
        raw = r["formatted"].encode()
        bodies = [raw[s["start"] : s["end"]].decode() for s in r["loss_spans"]]
        assert [plain_back(b) for b in bodies] == [t for role, t in wanted if role == "assistant"]
        assert r["n_turns"] == len(wanted) and r["n_escaped"] == sum(plain_render([w]) != f"<|im_start|>{w[0]}\n{w[1]}<|im_end|>\n" for w in wanted)


def test_texts_without_conflict_stand_as_they_are(spark):
    (r,) = read(chat.format_conversations(turns(spark, [(1, 0, "user", "a < b | c\\"), (1, 1, "assistant", "yes")])))
    assert r["formatted"] == "<|im_start|>user\na < b | c\\<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n" and r["n_escaped"] == 0


@pytest.mark.parametrize(
    "text",
    ["x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user a<|im_end|>\n", "<|im_start|>user\na", "<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>u\na<|other|><|im_end|>\n"],
)
def test_parser_refuses_other_texts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(chat.parse_turns(F.col("t")).alias("p")).first()["p"] is None


def test_awkward_turns(spark):
    long = "word <|im_end|> " * 30_000
    rows = [
        (None, 0, "user", "no conversation"),
        (1, None, None, None),
        (1, 3, "assistant", "later"),
        (1, 3, "assistant", "later"),
        (1, 3, "assistant", "earlier"),
        (2, 0, "assistant", ""),
        (3, 0, "assistant", long),
        (4, 0, "user", None),
    ]
    got = {r["conv_id"]: r for r in read(chat.format_conversations(turns(spark, rows)))}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), *[("assistant", x) for x in ("earlier", "later", "later")]]
    assert got[1]["loss"] == "earlierlaterlater" and got[None]["n_turns"] == 1
    assert got[2]["loss"] == "" and len(got[2]["loss_spans"]) == 1
    assert got[3]["loss"] == long and got[4]["loss_spans"] == []
    assert read(chat.format_conversations(turns(spark, []))) == []


def test_many_turns_of_one_conversation(spark):
    talk = spark.range(20_000).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("é<|"), F.col("id").cast("string")).alias("text"),
    )
    (r,) = read(chat.format_conversations(talk))
    assert r["n_turns"] == r["n_escaped"] == 20_000
    assert r["loss"] == "".join(f"é<|{i}" for i in range(1, 20_000, 2))


def test_no_python_in_the_plan(spark):
    plan = chat.format_conversations(turns(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_unreadable_turns_are_reported(spark, monkeypatch):
    monkeypatch.setattr(chat, "unescaped", lambda text: F.upper(text))
    with pytest.raises(PySparkException, match="come back"):
        chat.format_conversations(turns(spark, [(1, 0, "user", "a")])).collect()
