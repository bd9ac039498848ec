"""Code sets: from a label to standard codes, local ids and flags on records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.arrays import overlaps
from cohortspark.functions.strings import lab_code, split_code
from cohortspark.session import broadcast_if_small


def expand_by_hierarchy(codes: DataFrame, concept: DataFrame, ancestor: DataFrame) -> DataFrame:
    """(label, code) with every descendant's code added.

    The ancestor table is transitively closed, so one pass of three joins is enough.
    """
    start = codes.join(concept.select("concept_id", F.col("concept_code").alias("code")), "code")
    below = start.join(ancestor.withColumnRenamed("ancestor_concept_id", "concept_id"), "concept_id").select(
        "label", F.col("descendant_concept_id").alias("concept_id"))
    found = below.join(concept, "concept_id").select("label", F.col("concept_code").alias("code"))
    return codes.select("label", "code").unionByName(found).distinct()


def expand_by_relationship(codes: DataFrame, concept: DataFrame, relationship: DataFrame) -> DataFrame:
    """(label, code) with the codes one relationship away added. The relationship table is never broadcast by hint."""
    start = codes.join(concept.select("concept_id", F.col("concept_code").alias("code")), "code")
    near = start.join(relationship.withColumnRenamed("concept_id_1", "concept_id"), "concept_id").select(
        "label", F.col("concept_id_2").alias("concept_id"))
    found = near.join(concept, "concept_id").select("label", F.col("concept_code").alias("code"))
    return codes.select("label", "code").unionByName(found).distinct()


def concept_codes(codes: DataFrame, concept: DataFrame, ancestor: DataFrame | None = None,
                  relationship: DataFrame | None = None) -> DataFrame:
    """Codes of a label with their names, optionally expanded."""
    if ancestor is not None:
        codes = expand_by_hierarchy(codes, concept, ancestor)
    if relationship is not None:
        codes = expand_by_relationship(codes, concept, relationship)
    named = concept.select(F.col("concept_code").alias("code"), F.col("concept_name").alias("name"))
    return codes.select("label", "code").distinct().join(named, "code").select("label", "code", "name").distinct()


def source_ids(codes: DataFrame, mapping: DataFrame, vocabulary: str, id_column: str) -> DataFrame:
    """Local ids (with instance) of each label; the mapping holds 'VOCAB#code' texts."""
    parts = mapping.withColumn("_c", split_code(F.col("concept"))).where(F.col("_c.vocabulary") == vocabulary)
    local = parts.select(F.col("value").alias(id_column), "instance", F.col("_c.code").alias("code"))
    return local.join(broadcast_if_small(codes), "code").select("label", id_column, "instance").distinct()


def reverse_codes(ids: DataFrame, mapping: DataFrame, concept: DataFrame, vocabulary: str, id_column: str,
                  term_types: Sequence[str] | None = None) -> DataFrame:
    """Standard codes and names of local ids as aligned ';' lists, ordered by code.

    A list holds at most the distinct codes mapped to one id, so it is bounded by the vocabulary.
    """
    parts = mapping.withColumn("_c", split_code(F.col("concept"))).where(F.col("_c.vocabulary") == vocabulary)
    if term_types is not None:
        parts = parts.where(F.col("termtype").isin(*term_types))
    local = parts.select(F.col("value").alias(id_column), "instance", F.col("_c.code").alias("code"))
    named = concept.select(F.col("concept_code").alias("code"), F.col("concept_name").alias("name"))
    pairs = ids.select(id_column, "instance").distinct().join(local, [id_column, "instance"]).join(named, "code", "left")
    pairs = pairs.select(id_column, "instance", "code", "name").distinct()
    listed = F.array_sort(F.collect_list(F.struct("code", "name")))
    both = pairs.groupBy(id_column, "instance").agg(listed.alias("_l"))
    return both.select(
        id_column, "instance", F.array_join(F.transform("_l", lambda x: x["code"]), ";").alias("codes"),
        F.array_join(F.transform("_l", lambda x: F.coalesce(x["name"], F.lit(""))), ";").alias("names"))


def filter_by_codes(df: DataFrame, ids: DataFrame, labels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows whose id belongs to any of the labels: a semi join, no predicate text built from ids."""
    return df.join(ids.where(F.col("label").isin(*labels)).select(*keys).distinct(), list(keys), "left_semi")


def add_concept_flags(df: DataFrame, ids: DataFrame, id_column: str, labels: Sequence[str]) -> DataFrame:
    """One boolean column per label, from a single join: the id's flags are made one row per id first."""
    keys = [id_column, "instance"]
    per_id = ids.where(F.col("label").isin(*labels)).groupBy(*keys).agg(
        *[F.bool_or(F.col("label") == x).alias(x) for x in labels])
    joined = df.join(broadcast_if_small(per_id), keys, "left")
    return joined.withColumns({x: F.coalesce(F.col(x), F.lit(False)) for x in labels})


def add_concept_values(df: DataFrame, codes: Column, value: str, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per label with the row's value when any of its codes belongs to the label, else null."""
    new = {name: F.when(overlaps(codes, members), F.col(value)) for name, members in labels.items()}
    return df.withColumns(new) if new else df


def string_match(searches: Mapping[str, Sequence[str]]) -> Column:
    """Every searched column contains any of its terms; null columns do not match."""
    def one(col: str, terms: Sequence[str]) -> Column:
        hits = [F.lower(F.col(col)).contains(t.lower()) for t in terms]
        return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))

    return reduce(lambda a, b: a & b, [one(c, t) for c, t in searches.items()])


def add_string_values(df: DataFrame, value: str, labels: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    return df.withColumns({n: F.when(string_match(s), F.col(value)) for n, s in labels.items()})


def add_lab_codes(results: DataFrame, name: str = "result_name", code: str = "loinc_code",
                  default_code: str = "default_loinc_code") -> DataFrame:
    """Adds the set of all codes ever seen for the result's name (bounded by the vocabulary)."""
    mapped = results.select(name, lab_code(F.col(code), F.col(default_code)).alias("_code")).distinct()
    sets = mapped.groupBy(name).agg(F.sort_array(F.collect_set("_code")).alias("lab_codes"))
    return results.join(broadcast_if_small(sets), name, "left")


def flags_from_wide(df: DataFrame, labels: Mapping[str, Sequence[str]], prefix: str = "SNOMED_") -> DataFrame:
    """Label = OR of its precomputed '<prefix><code>' columns; a label without any such column is false."""
    new = {}
    for label, codes in labels.items():
        present = [F.coalesce(F.col(f"{prefix}{c}"), F.lit(False)) for c in codes if f"{prefix}{c}" in df.columns]
        new[label] = reduce(lambda a, b: a | b, present) if present else F.lit(False)
    return df.withColumns(new)


def any_concept(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows with at least one label: true for boolean columns, not null for the others."""
    types = dict(df.dtypes)
    tests = [F.col(c) if types[c] == "boolean" else F.col(c).isNotNull() for c in labels]
    return df.where(reduce(lambda a, b: a | b, tests))


def resolved_names(hits: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Resolution hits to one row per label: first of the first non-empty '|' list over ``sources``."""
    best = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in sources])
    return hits.withColumn("resolved_id", F.get(F.split(best, r"\|"), F.lit(0)))
