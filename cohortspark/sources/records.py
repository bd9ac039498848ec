"""Record getters: a cohort left-joined to one kind of record, with derived columns, filter and omissions.

Source tables are passed in a ``Records`` bundle, so no global view name is involved. Only the columns that
a caller keeps are read: projections stay in the plan and reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import age_years
from cohortspark.functions.strings import lab_code
from cohortspark.operators.concepts import add_concept_flags, add_concept_values, add_lab_codes
from cohortspark.operators.joins import fan_out
from cohortspark.session import broadcast_if_small

PERSON = ["pat_id", "instance"]

# Columns left out by default, per table.
DEFAULT_OMISSIONS: dict[str, list[str]] = {
    "person": ["birth_datetime", "first_name", "middle_name", "last_name", "full_name", "curr_loc_id", "zip"],
    "person_race": [],
    "encounter": [
        "obstetric_status", "mode_of_arrival", "appointment_datetime", "appointment_status", "arrival_datetime",
        "confirmation_status", "cancel_reason", "expected_admission_date", "expected_discharge_date",
        "discharge_destination", "discharge_transportation", "accomodation_code", "acuity", "facility_state",
        "facility_zip", "hospital_area_id", "hsp_account_id", "admission_prov_id", "discharge_prov_id",
        "visit_prov_id", "bed_id", "bill_attend_prov_id", "ed_episode_id", "ip_episode_id", "pri_problem_id", "room_id",
    ],
    "adtevent": ["adt_room_id", "adt_bed_id"],
    "admissionreason": ["pat_enc_date_real"],
    "chiefcomplaint": ["pat_enc_date_real"],
    "encounterdiagnosis": ["pat_enc_date_real"],
    "medicalhistory": [],
    "notes": ["author_provider_type", "author_user_id", "entry_user_id"],
    "procedureorders": [
        "parent_order_id", "order_priority", "order_set", "referral_class", "referral_expiration_date",
        "referral_number_of_visits", "referral_priority", "referral_reason", "referral_type",
        "referred_to_department_id", "referred_to_facility_id", "referred_to_specialty", "requested_instant_utc",
        "future_or_stand", "authorizing_prov_id",
    ],
    "cardiovascularfinding": ["ord_date_real", "finding_id"],
    "labresult": [
        "organism_id", "organism_name", "organism_quantity", "organism_quantity_unit", "compon_lnc_id",
        "default_lnc_id", "fulladd_lresult_comment",
    ],
    "medicationorders": [
        "authorizing_prov_id", "department_id", "ord_prov_id", "order_priority", "order_set", "requested_instant_utc",
    ],
    "medication": ["controlled"],
    "medicationadministration": ["due_datetime", "scheduled_for_datetime", "scheduled_on_datetime"],
    "flowsheetentry": ["current_date", "entry_user_id", "instant_recorded_local", "taken_user_id"],
    "flowsheetdefinition": ["can_be_graphed", "cross_encounter", "multiselect", "stores_calculated_data"],
    "flowsheet": [],
    "inpatientdata": [],
    "episode": [
        "labor_onset_datetime", "induction_datetime", "ob_sticky_note_text", "pregravid_bmi", "pregravid_weight",
    ],
    "deliverysummary": [
        "ob_time_rom_to_delivery", "start_pushing_instant", "delivery_birth_instant", "ob_delivery_induction_date",
        "antibiotics_during_labor", "delivery_placental_instant", "ob_delivery_1st_stage_hours",
        "ob_delivery_1ststage_minutes", "ob_delivery_2nd_stage_hours", "ob_delivery_2nd_stage_minutes",
        "ob_delivery_3rd_stage_hours", "ob_delivery_3rd_stage_minutes", "ob_delivery_blood_loss_ml",
        "ob_delivery_total_delivery_blood_loss_ml", "ob_delivery_dilation_complete_date",
    ],
    "obhistory": ["ob_hx_order"],
}

# Record kinds and the tables their getter reads.
GETTER_TABLES = {
    "person": ["person", "person_race"],
    "encounters": ["encounter", "adtevent", "admissionreason", "chiefcomplaint", "encounterdiagnosis", "medicalhistory",
                   "notes"],
    "procedure_orders": ["procedureorders", "cardiovascularfinding", "labresult"],
    "medication_orders": ["medicationorders", "medication", "medicationadministration"],
    "flowsheets": ["flowsheet", "flowsheetentry", "flowsheetdefinition", "inpatientdata"],
    "episodes": ["episode", "deliverysummary", "obhistory"],
}


def default_omissions(tables: Sequence[str] | None = None) -> list[str]:
    """Union of the default omission lists of the named tables (of all when none are named)."""
    chosen = DEFAULT_OMISSIONS if tables is None else {t: DEFAULT_OMISSIONS[t] for t in tables}
    return sorted({c for cols in chosen.values() for c in cols})


@dataclass
class Records:
    """The source tables by name, plus optional code mappings used for concept columns."""

    tables: Mapping[str, DataFrame]
    condition_ids: DataFrame | None = None  # (label, dx_id, instance)
    medication_ids: DataFrame | None = None  # (label, medication_id, instance)
    measure_codes: DataFrame | None = None  # (flo_meas_id, instance, code, ...)
    code_labels: Mapping[str, Sequence[str]] = field(default_factory=dict)  # label -> codes

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _finish(df: DataFrame, kind: str, where: str | None, omit: Sequence[str] | None) -> DataFrame:
    """The filter runs on the joined rows (it removes people without a matching record), then columns are dropped.

    ``omit=None`` drops the default columns of the kind's tables, ``omit=()`` keeps everything.
    """
    df = df.where(where) if where else df
    return df.drop(*(default_omissions(GETTER_TABLES[kind]) if omit is None else omit))


def _start(records: Records, cohort: DataFrame | None, columns: Sequence[str] | None) -> DataFrame:
    """The cohort with its person key and the requested columns."""
    cohort = person_cohort(records) if cohort is None else cohort
    wanted = list(dict.fromkeys([*PERSON, *(cohort.columns if columns is None else columns)]))
    return cohort.select(*wanted)


def _child(records: Records, allowed: Mapping[str, Sequence[str]], name: str | None):
    if name is None:
        return None, None
    if name not in allowed:
        raise ValueError(f"join_table must be one of {sorted(allowed)}")
    return records[name], list(allowed[name])


def person_cohort(records: Records, where: str | None = None, include_race: bool = True,
                  omit: Sequence[str] | None = None) -> DataFrame:
    """People with, optionally, the sorted set of their race answers."""
    people = records["person"]
    if include_race:
        race = records["person_race"].groupBy(*PERSON).agg(F.sort_array(F.collect_set("race")).alias("race"))
        people = people.join(race, PERSON, "left")
    return _finish(people, "person", where, omit)


ENCOUNTER_CHILDREN = {
    "adtevent": ["pat_enc_csn_id", "instance"], "admissionreason": ["pat_enc_csn_id", "instance"],
    "chiefcomplaint": ["pat_enc_csn_id", "instance"], "encounterdiagnosis": ["pat_enc_csn_id", "instance"],
    "medicalhistory": ["pat_enc_csn_id", "instance"], "notes": ["pat_enc_csn_id", "instance"],
}


def encounters(records: Records, cohort: DataFrame | None = None, cohort_columns: Sequence[str] | None = None,
               join_table: str | None = None, where: str | None = None, omit: Sequence[str] | None = None,
               concepts: Sequence[str] = ()) -> DataFrame:
    """Encounters, optionally with one child table, diagnosis names and a boolean column per condition label."""
    child, on = _child(records, ENCOUNTER_CHILDREN, join_table)
    df = fan_out(_start(records, cohort, cohort_columns), records["encounter"], PERSON)
    if "birth_date" in df.columns:
        df = df.withColumn("age_at_contact_dt", age_years(F.col("birth_date"), F.col("contact_date")))
    if child is not None:
        df = fan_out(df, child, on)
        if "dx_id" in df.columns:
            df = df.join(broadcast_if_small(records["diagnosis"]), ["dx_id", "instance"], "left")
            if concepts:
                df = add_concept_flags(df, records.condition_ids, "dx_id", concepts)
    return _finish(df, "encounters", where, omit)


PROCEDURE_CHILDREN = {
    "labresult": ["order_proc_id", "instance"], "cardiovascularfinding": ["order_proc_id", "instance"],
}


def procedure_orders(records: Records, cohort: DataFrame | None = None, cohort_columns: Sequence[str] | None = None,
                     join_table: str | None = None, where: str | None = None, omit: Sequence[str] | None = None,
                     concepts: Sequence[str] = ()) -> DataFrame:
    """Procedure orders, optionally with findings or lab results.

    A result has its own code, the set of all codes its name ever had (``lab_codes``), and a value column per lab label,
    filled when any code of the set belongs to the label.
    """
    child, on = _child(records, PROCEDURE_CHILDREN, join_table)
    df = fan_out(_start(records, cohort, cohort_columns), records["procedureorders"], PERSON)
    if "birth_date" in df.columns:
        df = df.withColumn("age_at_order_dt", age_years(F.col("birth_date"), F.col("ordering_datetime")))
    if child is not None:
        df = fan_out(df, add_lab_codes(child) if join_table == "labresult" else child, on)
        if join_table == "labresult":
            df = df.withColumn("lab_code", lab_code(F.col("loinc_code"), F.col("default_loinc_code")))
            df = add_concept_values(df, F.col("lab_codes"), "result_value", {c: records.code_labels[c] for c in concepts})
    return _finish(df, "procedure_orders", where, omit)


def medication_orders(records: Records, cohort: DataFrame | None = None, cohort_columns: Sequence[str] | None = None,
                      join_table: str | None = None, where: str | None = None, omit: Sequence[str] | None = None,
                      concepts: Sequence[str] = ()) -> DataFrame:
    """Medication orders with drug names, optionally administrations and a boolean column per drug label."""
    child, on = _child(records, {"medicationadministration": ["order_med_id", "instance"]}, join_table)
    df = fan_out(_start(records, cohort, cohort_columns), records["medicationorders"], PERSON)
    if "birth_date" in df.columns:
        df = df.withColumn("age_at_order_dt", age_years(F.col("birth_date"), F.col("ordering_datetime")))
    df = df.join(broadcast_if_small(records["medication"]), ["medication_id", "instance"], "left")
    if child is not None:
        df = fan_out(df, child, on)
    if concepts:
        df = add_concept_flags(df, records.medication_ids, "medication_id", concepts)
    return _finish(df, "medication_orders", where, omit)


def flowsheets(records: Records, cohort: DataFrame | None = None, cohort_columns: Sequence[str] | None = None,
               join_table: str | None = None, where: str | None = None, omit: Sequence[str] | None = None,
               concepts: Sequence[str] = ()) -> DataFrame:
    """Sheet -> entry -> definition -> code of the measure, with a value column per device or vital label."""
    child, on = _child(records, {"inpatientdata": ["inpatient_data_id", "instance"]}, join_table)
    df = fan_out(_start(records, cohort, cohort_columns), records["flowsheet"], PERSON)
    df = fan_out(df, records["flowsheetentry"], ["fsd_id", "instance"])
    df = df.join(broadcast_if_small(records["flowsheetdefinition"]), ["flo_meas_id", "instance"], "left")
    if records.measure_codes is not None:
        df = df.join(broadcast_if_small(records.measure_codes), ["flo_meas_id", "instance"], "left")
        df = add_concept_values(df, F.array("code"), "value", {c: records.code_labels[c] for c in concepts})
    if "birth_date" in df.columns:
        df = df.withColumn("age_at_recorded_dt", age_years(F.col("birth_date"), F.col("recorded_time")))
    if child is not None:
        df = fan_out(df, child, on)
    return _finish(df, "flowsheets", where, omit)


def episode_blocks(records: Records, cohort: DataFrame | None = None, cohort_columns: Sequence[str] | None = None,
                   join_tables: Sequence[str] = ("deliverysummary", "obhistory"), where: str | None = None,
                   omit: Sequence[str] | None = None) -> DataFrame:
    """Episodes with their delivery summary and obstetric history."""
    unknown = sorted(set(join_tables) - {"deliverysummary", "obhistory"})
    if unknown:
        raise ValueError(f"unknown tables: {unknown}")
    df = fan_out(_start(records, cohort, cohort_columns), records["episode"], PERSON)
    if "birth_date" in df.columns:
        df = df.withColumn("age_at_start_dt", age_years(F.col("birth_date"), F.col("start_date")))
    if "deliverysummary" in join_tables:
        summary = records["deliverysummary"].withColumnRenamed("summary_block_id", "episode_id")
        df = df.join(summary, ["episode_id", "instance"], "left")
    if "obhistory" in join_tables:
        df = df.join(records["obhistory"], ["episode_id", "instance"], "left")
    return _finish(df, "episodes", where, omit)
