"""Personal data: patterns for the entities, corpus co-occurrence for the terms that give them away.

Entities are found by pattern and protected by what several texts can share of them: the domain of an address, the subnet of
an IP number, the issuer of a card, the first digits of a phone number. A term reveals such a group when seeing it tells
where the group stands. With counts over different texts, PMI(t; e) = log2(P(e | t) / P(e)), of which the group's information
IC(e) = -log2 P(e) is the most there can be. P(e | t) is taken at its lower confidence bound (Wilson), so a term seen once or
twice proves nothing, at any size of the corpus. A term discloses a group if that bound makes the group likelier than not and
the PMI reaches a share ``GENERAL`` of the IC: it is then generalised to ``[term]``, and from a share ``REMOVE`` on taken out.
Entities themselves are generalised to their kind.

Texts are scanned where they lie. Only those that hold entities are stored and counted with their terms; of the others, the terms
that could disclose something are counted. No other text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import BLANKS, WORD, broadcast_measured, no_null, span_list, span_text, split_join, stored, unwrapped, with_spans
from cohortspark.llm.registry import query, read
from cohortspark.session import durable

# The patterns of the base kinds. Possessive repeats and the look-behinds find the same spans without
# trying a long run again from each of its characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
SKIP_BYTES = 32 * 1024 * 1024
GENERAL = 0.6
REMOVE = 0.9
BELIEF = 0.5
Z = 1.96
# Digits that phone numbers and cards of one group share.
PREFIX = 6
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# What is shaped like an entity is no term; of numbers only those as long as an entity's.
SHAPES = "|".join([PATTERNS["email"], PATTERNS["ip"], PATTERNS["phone"], r"[0-9](?:[\x20-]?[0-9]){11,}+"])
TOLD = ("term", "gone")
SPAN = "array<struct<start:bigint,end:bigint>>"


def _luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits: from the right, every second digit doubled, nines taken off."""
    back = F.reverse(digits)
    one = lambda i: F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + one(i) - F.when(one(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(match, r"\."), lambda p: F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255)
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _valid(kind: str) -> Column:
    return F.filter(F.col(kind), lambda s: _holds(kind, s["match"]))


def entities(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds one array of (start, end, match, part) per kind: leftmost, non-overlapping matches, failing ones dropped."""
    found = with_spans(texts, text, PATTERNS)
    return found.select(*texts.columns, *[_valid(k).alias(k) for k in KINDS])


def _groups() -> Column:
    """Distinct protected groups of a row's entities."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    of = {
        "email": lambda m: F.lower(F.substring_index(m, "@", -1)),
        "ip": lambda m: F.substring_index(m, ".", 3),
        "card": lambda m: F.left(digits(m), F.lit(PREFIX)),
        "phone": lambda m: F.left(digits(m), F.lit(PREFIX)),
    }
    empty = F.array().cast("array<string>")
    keys = lambda k: F.coalesce(F.transform(F.col(k), lambda s: F.concat(F.lit(k + ":"), of[k](s["match"]))), empty)
    return F.array_distinct(F.concat(*[keys(k) for k in KINDS]))


def _bare(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def terms(text: Column) -> Column:
    """Distinct words, without the punctuation around them and lower-cased."""
    return F.array_remove(F.array_distinct(F.transform(F.split(text, BLANKS), lambda w: F.lower(_bare(w)))), "")


def _likely(both: Column, seen: Column) -> Column:
    """Lower bound of the share ``both / seen``."""
    n, p = seen.cast("double"), both / seen.cast("double")
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _blob() -> Column:
    return F.sha2(no_null(F.col("text")), 256)


def revealing(docs: DataFrame, holders: DataFrame, skip: DataFrame) -> DataFrame:
    """Terms that disclose protected groups: ``entity, term, ratio`` (bound of the PMI over the group's information).

    ``holders`` has one row per different text with entities (``blob``, ``bare``: without what looks like one, ``keys``); ``skip`` the
    ``blob`` of each of these and, as ``rep``, the doc_id by which other repeated texts count (null for holders).
    """
    spark = docs.sparkSession
    none = spark.createDataFrame([], "entity string, term string, ratio double")
    known = durable(holders.select(F.explode("keys").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")))
    own = holders.select(F.explode(terms(F.col("bare"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_own"))
    # However few other texts have a term, it needs this many with entities.
    own = durable(own.where(_likely(F.col("n_own"), F.col("n_own")) >= BELIEF))
    if not own.limit(1).count():
        return none
    rest = docs.select(_blob().alias("blob"), F.col("doc_id").alias("doc"), no_null(F.col("text")).alias("text")).join(
        broadcast_measured(skip, SKIP_BYTES).withColumn("known", F.lit(True)), "blob", "left")
    rest = rest.where(F.col("known").isNull() | (~F.col("holds") & F.col("rep").eqNullSafe(F.col("doc"))))
    wanted = broadcast_measured(own)
    other = rest.select(F.explode(terms(F.col("text"))).alias("term")).join(wanted.select("term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_other"))
    single = own.join(other, "term", "left").select("term", "n_own", (F.col("n_own") + F.coalesce("n_other", F.lit(0))).alias("n_t"))
    # P(e | t) is at most the share of the term's texts that hold any entity.
    single = durable(single.where(_likely(F.col("n_own"), F.col("n_t")) >= BELIEF).select("term", "n_t"))
    total = float(skip.where("holds").count() + _others(docs, skip))
    pairs = holders.select("keys", F.explode(terms(F.col("bare"))).alias("term")).join(broadcast_measured(single), "term").select(
        F.explode("keys").alias("entity"), "term", "n_t").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_t").alias("n_t"))
    likely = _likely(F.col("n_te"), F.col("n_t"))
    counted = pairs.join(known, "entity").where(likely >= BELIEF)
    information = F.log2(F.lit(total) / F.col("n_e"))
    ratio = F.when(information > 0, F.log2(likely * F.lit(total) / F.col("n_e")) / information)
    return durable(counted.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= GENERAL))


def _others(docs: DataFrame, skip: DataFrame) -> int:
    """Number of different texts that hold no entity."""
    copies = skip.agg(F.sum(F.when(F.col("holds"), F.col("n")).otherwise(F.col("n") - 1))).first()[0] or 0
    return docs.count() - copies


def find(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and others) with the arrays ``email, ip, card, phone``, and ``term`` and ``gone`` for the
    words to be generalised and removed; each holds (start, end, ...) of the spans, null where nothing is found.

    A word counts by the closest disclosure of any of the row's own groups. Equal texts are one observation. A null text is empty;
    no rows give no rows. Without ``texts`` the column text is left out, so that texts without entities are not stored.
    """
    kept = [c for c in docs.columns if texts or c != "text"]
    held = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").alias("doc"), _blob().alias("blob"), no_null(F.col("text")).alias("text"))
    scanned = entities(held).withColumn("keys", _groups())
    holds = F.size("keys") > 0
    scanned = stored(scanned.withColumn("text", F.when(holds, F.col("text"))), "entities")
    holders = scanned.where(holds)
    skip = durable(scanned.groupBy("blob").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"), F.max(holds).alias("holds")).where("n > 1 OR holds"))
    taken = F.concat(*[F.coalesce(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.array().cast(SPAN)) for k in KINDS])
    different = stored(holders.groupBy("blob").agg(F.first("text").alias("text"), F.first("keys").alias("keys"), F.first(taken).alias("taken")), "holders")
    told = revealing(docs, different.select("blob", "keys", F.regexp_replace("text", SHAPES, " ").alias("bare")), skip)
    marked = split_join(holders, _told_spans(different, told), "blob") if told.limit(1).count() else holders.select("*", *[F.lit(None).cast(SPAN).alias(k) for k in TOLD])
    none = scanned.where(~holds).select("*", *[F.lit(None).cast(SPAN).alias(k) for k in TOLD])
    return unwrapped(marked.unionByName(none), kept, **{k: k for k in (*KINDS, *TOLD)})


def _told_spans(different: DataFrame, told: DataFrame) -> DataFrame:
    """``blob, term, gone``: the spans of the words that disclose a group of their text.

    Words are looked up by a join on the word, of which few groups are told; only texts that hold one are cut into words with
    their places.
    """
    met = different.select("blob", "keys", F.explode(terms(F.col("text"))).alias("term")).join(broadcast_measured(told), "term")
    best = durable(met.where(F.array_contains("keys", F.col("entity"))).groupBy("blob", "term").agg(F.max("ratio").alias("ratio")))
    texts = different.join(best.select("blob").distinct(), "blob", "left_semi")
    pieces = texts.select("blob", F.posexplode(F.regexp_extract_all("text", F.lit(f"{WORD}|{BLANKS}"), F.lit(0))).alias("at", "piece"))
    before = Window.partitionBy("blob").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    left = F.length("piece") - F.length(F.ltrim("piece", F.lit(PUNCTUATION)))
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("bigint") + left
    words = pieces.select("blob", _bare(F.col("piece")).alias("word"), start.alias("start"))
    placed = words.select("blob", F.lower("word").alias("term"), "start", (F.col("start") + F.length("word")).alias("end"))
    hit = placed.join(best, ["blob", "term"]).join(texts.select("blob", "taken"), "blob")
    # The word may still stand inside an entity of this text.
    free = hit.where(~F.exists("taken", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])))
    span = F.struct("start", "end")
    return free.groupBy("blob").agg(*[F.sort_array(F.collect_list(F.when(on, span))).alias(k) for k, on in zip(TOLD, (F.col("ratio") < REMOVE, F.col("ratio") >= REMOVE))])


def sanitise(found: DataFrame, text: str = "text", out: str = "clean") -> DataFrame:
    """Adds the text with entities replaced by their kind in brackets, disclosing terms by ``[term]`` or, if told to go, by nothing.

    Of spans that overlap, the one that starts first (then the kind named first) is replaced, the others are not.
    """
    merged = F.aggregate(span_list([*KINDS, *TOLD]), F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done")), lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
            acc["done"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
            F.when(s["kind"] == "gone", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("done"))).otherwise(acc))
    step = found.select("*", merged.alias("_m"))
    rest = F.substring(no_null(F.col(text)), (F.col("_m.at") + 1).cast("int"), F.length(no_null(F.col(text))))
    return step.withColumn(out, F.concat("_m.done", rest)).drop("_m")


@query("op10_privacy")
def op10_privacy(spark, folder):
    """All documents' entities, and the words that disclose their groups."""
    found = find(read(spark, folder, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", *[F.coalesce(F.size(k), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
                        F.sha2(span_text(span_list(KINDS)), 256).alias("base_sha256"), span_text(span_list([*KINDS, *TOLD])).alias("spans"))
