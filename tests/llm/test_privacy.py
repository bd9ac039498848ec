import hashlib
import math
import re
from collections import Counter

from cohortspark.llm.privacy import KINDS, find, sanitise
from cohortspark.llm.common import span_list, span_text

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def plain_spans(text):
    found = [(m.start(), i, m.end(), k, m.group()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(k, m.group())]
    return sorted(found)


TEXTS = [
    None, "", "no data at all", "mail a@b.c@d.e and x.y+z@host-1.example.org. end", "a@b.cd%e@f.g @x.y a@b", "ip 1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.1.1 999999999999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 378282246310005 1234", "phone +1 (555) 010-9999 x +49 30 123456789012345 +1 2 +12345678901",
    "é𝄞 user@exämple.org 𝄞a@b.org  +49-30-1234567", "4111 1111 1111 1111 4111 1111 1111 1111", "1" * 30000, "a" * 50000 + " " + "b@" * 5000 + "c.d",
    " ".join(f"u{i}@ex.org" for i in range(1000)),
]


def test_base_spans_equal_plain_ones(spark, documents):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[4])])
    got = find(docs).select("doc_id", span_text(span_list(KINDS)).alias("s"), *KINDS).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = plain_spans(TEXTS[4 if r["doc_id"] is None else r["doc_id"]])
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in want), r["doc_id"]
        assert hashlib.sha256(r["s"].encode()).hexdigest()
        for k in KINDS:
            assert len(r[k] or []) == sum(1 for w in want if w[3] == k)
    assert find(docs.limit(0)).collect() == []


PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHAPE = re.compile("|".join([PLAIN["email"], PLAIN["ip"], PLAIN["phone"], r"[0-9]([\x20-]?[0-9]){11,}"]))


def low(both, seen, z=1.96):
    p = both / seen
    return (p + z * z / (2 * seen) - z * math.sqrt(p * (1 - p) / seen + z * z / (4 * seen * seen))) / (1 + z * z / seen)


def groups(text):
    out = set()
    for *_, k, m in plain_spans(text):
        digits = re.sub("[^0-9]", "", m)
        out.add(k + ":" + {"email": m.split("@")[-1].lower(), "ip": ".".join(m.split(".")[:3]), "card": digits[:6], "phone": digits[:6]}[k])
    return out


def bag(text):
    return {w.strip(PUNCT).lower() for w in re.split(r"[\x20\x09-\x0D]+", text)} - {""}


def plain_told(texts):
    """Ratio of every (group, term) that is disclosed, counted over different texts."""
    texts, told = {t or "" for t in texts}, {}
    of = {t: groups(t) for t in texts}
    words = {t: bag(SHAPE.sub(" ", t) if of[t] else t) for t in texts}
    for e in set().union(*of.values()):
        n_e = sum(e in g for g in of.values())
        for w in set().union(*(words[t] for t in texts if e in of[t])):
            n_t, n_te = sum(w in x for x in words.values()), sum(w in words[t] and e in of[t] for t in texts)
            p, ic = low(n_te, n_t), math.log2(len(texts) / n_e)
            if p >= 0.5 and ic > 0 and math.log2(p * len(texts) / n_e) / ic >= 0.6:
                told[e, w] = math.log2(p * len(texts) / n_e) / ic
    return told


def plain_words(text, told):
    """Spans of the disclosing words outside entities, by what becomes of them."""
    mine, taken, out = groups(text), [(a, b) for a, _, b, _, _ in plain_spans(text)], {"term": [], "gone": []}
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        start, word = m.start() + len(m.group()) - len(m.group().lstrip(PUNCT)), m.group().strip(PUNCT)
        ratio = max((told.get((e, word.lower()), 0) for e in mine), default=0)
        if ratio and not any(a < start + len(word) and start < b for a, b in taken):
            out["gone" if ratio >= 0.9 else "term"].append((start, start + len(word)))
    return out


def clinic(n):
    rows = [(i, f"Dr Zorn's clinic Alpha, write to p{i}@Clinic.org today, staff jdoe42 number{i} İ filler") for i in range(6)]
    rows += [(10 + i, f"filler today other words item{i}") for i in range(n)] + [(900 + i, f"clinic of another kind {i}") for i in range(4)]
    rows += [(920 + i, f"Call +49 30 12345{i}0, Nordwall or (Nordwall) today {i} filler") for i in range(9)] + [(930, "nordwall without number")]
    rows += [(940, rows[0][1]), (941, "(ALPHA) again: zorn@clinic.org, JDOE42"), (942, "alpha only"), (None, rows[1][1]), (943, rows[12][1]), (944, None), (945, "")]
    return rows + [(950, "one 10.1.2.3 rare words that stand nowhere else")]


def test_disclosing_terms_equal_counting(documents):
    rows = clinic(400)
    told = plain_told([t for _, t in rows])
    names = {w for _, w in told}
    assert {"zorn's", "alpha", "jdoe42", "nordwall"} <= names and not names & {"filler", "today", "clinic", "rare", "nowhere"}
    assert {r >= 0.9 for r in told.values()} == {True, False}
    found = find(documents(rows)).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in found) == sorted(map(str, rows))
    for r in found:
        got = {k: [(s["start"], s["end"]) for s in r[k] or []] for k in ("term", "gone")}
        assert got == plain_words(r["text"], told), r["doc_id"]
    assert "text" not in find(documents(rows), texts=False).columns


def test_entities_of_one_text_disclose_nothing(documents):
    rows = [(0, "Zorn of Quellburg writes from info@clinic.org about " + " ".join(f"rare{i}" for i in range(20000)))] + [(i, f"about item {i}") for i in range(1, 40)]
    assert all(not r["term"] and not r["gone"] for r in find(documents(rows)).collect())


def test_sanitised_texts(documents):
    clean = {r["doc_id"]: r["clean"] for r in sanitise(find(documents(clinic(400)))).collect()}
    assert clean[930] == "nordwall without number" and clean[942] == "alpha only" and clean[944] == clean[945] == ""
    assert clean[950] == "one [ip] rare words that stand nowhere else"
    assert "[email]" in clean[941] and "ALPHA" not in clean[941] and "JDOE42" not in clean[941]
    assert "[phone]" in clean[925] and "Nordwall" not in clean[925]
