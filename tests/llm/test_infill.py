import hashlib
import re

import numpy as np
import pytest

from cohortspark.llm.infill import Frames, choice, framed, output, restored, transformed, write

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
TEXTS = [None, "", "a", "<", "<P", "word", "has <S> inside", "<<P>", "é𝄞日 本\u0000\n\r\n end.", "P>S>M> <", "<" * 50, "x" * 3000, "ab1 " * 2000, "日本" * 900 + "é",
         "word " * 40000, "𝄞" * 999 + "letters" * 500 + "𝄞"]


def plain(key, text):
    units = UNIT.findall(text or "")
    n, h = len(units), hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text or ""
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_units_join_to_the_text():
    assert all("".join(UNIT.findall(t)) == t for t in TEXTS if t)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 15])
def test_frames_find_every_unit(size):
    for text in (t for t in TEXTS if t and len(t) <= 4000):
        held, units = framed(text.encode(), size), UNIT.findall(text)
        assert b"".join(held.stream()) == text.encode() and held.units[-1] == len(units) and held.chars[-1] == len(text)
        for u in {0, 1, len(units) // 2, len(units) - 1, len(units)}:
            frame, byte, chars = held.place(u)
            assert chars == len("".join(units[:u]))
            assert b"".join(held.stream((0, 0), (frame, byte))).decode() == "".join(units[:u])
            assert b"".join(held.stream((frame, byte))).decode() == "".join(units[u:])


def test_a_cut_opens_one_frame(monkeypatch):
    held, opened = framed(b"word " * 100_000, 1000), []
    frame = Frames.frame
    monkeypatch.setattr(Frames, "frame", lambda self, i: opened.append(i) or frame(self, i))
    held.place(123_456)
    assert len(opened) == 1 and len(held.at) > 300


def test_outputs_restore_at_any_piece_size():
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = "".join(rng.choice(list("<PSM>ab é"), 30))
        for form in ("psm", "spm"):
            if re.search("<[PSM]>", text):
                continue
            held = framed(text.encode(), 4)
            _, one, two = choice(text, held.units[-1], False)
            out = b"".join(output(held, form, held.place(one)[:2], held.place(two)[:2]))
            size = int(rng.integers(1, 9))
            assert b"".join(restored([out[i:i + size] for i in range(0, len(out), size)], form)).decode() == text


def test_table_equals_brute_force(spark, documents, tmp_path):
    rows = [(100 * k + i, t) for k in range(8) for i, t in enumerate(TEXTS)] + [(None, "no id at all"), (3, "again, again"), (3, "again, again")]
    docs = documents(rows).selectExpr("*", "doc_id AS form")
    write(docs, str(tmp_path / "frames"), size=512)
    made = transformed(spark, str(tmp_path / "frames"))
    assert made.columns == [c for c in docs.columns if c not in ("text", "form")] + ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = sorted(str((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["output_sha256"], r["restored_sha256"])) for r in made.collect())
    want = [(i, *plain("null" if i is None else i, t)) for i, t in rows]
    assert got == sorted(str((*w, sha(w[-1]), sha(t))) for w, (_, t) in zip(want, rows))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    write(documents([]), str(tmp_path / "none"))
    assert transformed(spark, str(tmp_path / "none")).collect() == []
