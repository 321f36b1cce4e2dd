import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm.chat import Template, digests, escape, format_chats, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, segments string, _conv int"
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "]", "/", "s>", "a", "\n", "INST]", "$1", "é"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=20))
def test_round_trip(spark, turns):
    rows = [(k // 3, k, r, t, "x", 0) for k, (r, t) in enumerate(turns)]
    chats = format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", read_back(F.col("formatted")))
    for c in chats.collect():
        assert [tuple(x) for x in c.turns] == [(r, t) for k, _, r, t, *_ in rows if k == c.conv_id]
        assert "".join(s.text for s in c.segments) == c.formatted
        for s, (_, t) in zip(c.segments[1::3], [tuple(x) for x in c.turns], strict=True):
            assert not any(m in s.text for m in Template().controls)


def test_escape_is_reversible(spark):
    texts = ["<s>", "<\\s>", "<\\\\s>", "[/INST]", "[\\/INST] \\[INST]", "<<s>>", "plain", ""]
    t = Template()
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", escape(F.col("x"), t).alias("e"), unescape(escape(F.col("x"), t), t).alias("u")).collect()
    assert all(r.x == r.u for r in got) and len({r.e for r in got}) == len(texts)


def test_cases(spark):
    rows = [
        (1, 1, "assistant", "yes"), (1, 0, "user", None), (1, 1, "assistant", "yes"),
        (2, None, "system", "s"), (2, 1, None, "x" * 200_000), (None, 0, "user", "u"), (3, 0, "assistant", "</s>"),
    ]
    turns = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    got = {r.conv_id: r for r in digests(format_chats(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nyes\nassistant\nyes\n") and not got[1].valid
    assert got[1].loss_sha256 == sha("yesyes") and got[1].loss_chars == 6
    assert got[2].turns_sha256 == sha("system\ns\n\n" + "x" * 200_000 + "\n") and got[2].loss_chars == 0
    assert got[None].valid and got[3].loss_sha256 == sha("</s>") and not got[3].valid
    assert digests(format_chats(turns.limit(0))).count() == 0
