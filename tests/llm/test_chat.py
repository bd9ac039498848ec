import hashlib

from hypothesis import given
from hypothesis import strategies as st

from cohortspark.llm.chat import CONTROL, escape, format_turns, read_back, unescape

TEXTS = [None, "", "hello there", "</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST] \[INST]", "<|endoftext|> é𝄞\n\t ", "<<SYS>><</SYS>>[ROLE]x[/ROLE]", " ".join(f"w{i}" for i in range(20000))]


@given(st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "s>", "/s>", "INST]", "a", "S"]), max_size=12).map("".join))
def test_escape_is_reversible_and_complete(text):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)


def test_digests_read_back(spark):
    roles = ["user", "assistant", "system", "tool", None, "[ROLE]"]
    rows = [(c, t, roles[(c + t) % 6], TEXTS[(c * 3 + t) % 8]) for c in range(12) for t in range(c + 1)]
    rows += [(3, 1, "user", "same turn"), (3, 1, "user", "same turn"), (None, 0, "assistant", "no id"), (50, None, "assistant", "no turn")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: r for r in read_back(format_turns(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0], r[1], (r[2] + "\x00" + r[3]).encode()))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        extra = {"user": 13, "assistant": 7, "system": 15}
        assert got[c]["formatted_chars"] == sum(len(escape(x)) + extra.get(r, 17 + len(escape(r))) for *_, r, x in turns)
    assert read_back(format_turns(df.limit(0))).collect() == []
