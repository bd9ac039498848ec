import random

from cohortspark.llm.decontaminate import contained, decontaminate


def shingles(text, lengths=()):
    words, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha() or c.isnumeric():
            run += c
        elif run:
            words.append(run)
            run = ""
    return ({" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()) | (
        {" ".join(words[i:i + n]) for n in lengths for i in range(len(words) - n + 1)})


def test_equals_all_pairs(spark, documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([2, 3, 5, 6, 9, 20, 33, 60] * 3)] + [(90, None), (91, ""), (92, "?!"), (None, "an item without any id at all")]
    rows = []
    for i, (_, text) in enumerate(items):
        ws = (text or "").split()
        for k, drop in enumerate([0, 1, 2, 8]):
            kept = list(ws)
            for _ in range(drop):
                if kept:
                    kept[rng.randrange(len(kept))] = word()
            filler = [word() for _ in range(rng.choice([0, 30, 3000]))]
            rows.append((i * 10 + k, " ".join([*filler, *kept, *filler]).upper() if k % 2 else ",\n".join([*filler, *kept])))
    rows += [(9000, None), (9001, ""), (None, items[5][1]), (50, items[7][1]), (9002, " ".join(t or "" for _, t in items))]
    bench = spark.createDataFrame([(*i, "x") for i in items + [items[5]]], "item_id long, text string, hash string")
    docs = documents(rows)
    want = {}
    for d, t in rows:
        for i, x in items:
            s = shingles(x)
            both = len(s & shingles(t, (2, 3)))
            if s and both / len(s) >= 0.8 - 1e-12:
                want[d, i] = max(want.get((d, i), 0), both / len(s))
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in contained(docs, bench).collect()}
    assert got == want and len(want) > 30
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    hit = {d for d, _ in want}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in hit), key=str)
    assert contained(docs.limit(0), bench).collect() == [] and contained(docs, bench.limit(0)).collect() == []


def test_a_leak_takes_no_other_row_of_its_id(spark, documents):
    bench = spark.createDataFrame([(1, "seven words that make one benchmark item")], "item_id long, text string")
    leak = "before it seven words that make one benchmark item after it"
    docs = documents([(None, leak), (None, "clean words without any id"), (4, leak), (4, "clean words of a repeated id"), (5, None)])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontaminate(docs, bench).collect()) == [
        (0, "clean words without any id"), (4, "clean words of a repeated id"), (5, "")]


def test_short_items_are_found_inside_long_documents(spark, documents):
    bench = spark.createDataFrame([(1, "Quarrel"), (2, "red fox runs"), (3, "four words stand here"), (4, "five words stand right here")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(3000))
    docs = documents([(10, f"{filler} quarrel, {filler}"), (11, f"{filler} Red fox; runs"), (12, f"red fox {filler} runs"), (13, "four words stand here"), (14, f"four words stand right here {filler}"),
                      (15, "red fox"), (16, f"x five words stand right here {filler} four words stand here")])
    assert sorted((r["doc_id"], r["item_id"], r["containment"]) for r in contained(docs, bench).collect()) == [(10, 1, 1.0), (11, 2, 1.0), (13, 3, 1.0), (16, 3, 1.0), (16, 4, 1.0)]
