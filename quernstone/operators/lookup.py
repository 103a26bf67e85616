"""Exact lookups over patients, providers, records and admissions, and their readable form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories of source systems and the document type they stand for.
CATEGORY_TYPES = {
    "discharge summary": "record", "nursing": "record", "nursing/other": "record", "physician": "record", "general": "record", "case management": "record", "consult": "record",
    "radiology": "lab_result", "ecg": "lab_result", "echo": "lab_result", "rehab services": "record", "social work": "record", "pharmacy": "prescription",
}
#: Parts of file names and the document type they stand for, in order.
NAME_TYPES = (
    ("bill", "bill"), ("invoice", "bill"), ("provider", "provider_info"), ("npi", "provider_info"), ("doctor", "provider_info"),
    ("prescription", "prescription"), ("rx", "prescription"), ("lab", "lab_result"), ("record", "record"),
)


def category_type(category: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in CATEGORY_TYPES.items() for x in kv])
    return F.try_element_at(entries, F.lower(F.trim(category)))


def name_date(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def patient_records(records: DataFrame, patients: DataFrame, providers: DataFrame, record_type: str | None = None, record_date: str | None = None) -> DataFrame:
    """Records with their patient and, where there is one, their provider."""
    chosen = records
    if record_type is not None:
        chosen = chosen.where(F.col("record_type") == record_type)
    if record_date is not None:
        chosen = chosen.where(F.col("record_date") == record_date)
    p = patients.select(F.col("id").alias("patient_id"), F.col("name").alias("patient_name"), F.col("patient_id").alias("patient_mrn"))
    v = providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"), F.col("npi").alias("provider_npi"))
    return chosen.join(p, "patient_id").join(v, "provider_id", "left")


def by_admission(records: DataFrame, hadm_id: str, limit: int = 30) -> DataFrame:
    """Records of one admission by their sequence number; texts that are no number come last."""
    sequence = F.when(F.col("seq_num").rlike(r"^\d+$"), F.col("seq_num").try_cast("int"))
    return records.where(F.col("hadm_id") == hadm_id).orderBy(F.asc_nulls_last(sequence), "id").limit(limit)


def merge_details(columns: list[str], details: str = "details_json") -> Column:
    """String map of the non-empty columns, with entries of a JSON object where a column is empty; bad JSON adds nothing."""
    own = F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull() & (v != ""))
    more = F.map_filter(F.coalesce(F.from_json(F.col(details), "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != "") & ~F.map_contains_key(own, k))
    return F.map_concat(own, more)


def _line(label: str, column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(column)))


def record_text() -> Column:
    """The readable form of a record row with patient_name, provider_name and provider_npi."""
    kind = lambda t, *lines: [F.when(F.col("record_type") == t, x) for x in lines]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Patient: "), F.coalesce("patient_name", F.lit("Unknown"))),
        F.concat(F.lit("Record type: "), F.coalesce("record_type", F.lit("record"))),
        F.concat(F.lit("Date: "), F.coalesce("record_date", F.lit("unknown date"))),
        _line("Provider", "provider_name"),
        _line("NPI", "provider_npi"),
        *kind("visit", _line("Diagnosis", "diagnosis"), _line("Treatment", "treatment")),
        *kind("bill", F.when(F.coalesce("total_amount", F.lit("")) != "", F.concat(F.lit("Total amount: $"), F.col("total_amount"))), _line("Claim No", "claim_number")),
        *kind("prescription", _line("Medication", "medication"), _line("Dosage", "dosage")),
        *kind("lab_result", _line("Test", "test_name"), _line("Result", "test_result"), _line("Reference range", "reference_range")),
        _line("Admission (HADM_ID)", "hadm_id"),
        F.when(F.coalesce("icd9_code", F.lit("")) != "", F.concat(F.lit("ICD9: "), F.col("icd9_code"), F.coalesce(F.concat(F.lit(" - "), F.nullif("icd9_description", F.lit(""))), F.lit("")))),
        _line("Diagnosis sequence", "seq_num"),
    )


def band(score: Column) -> Column:
    """Relevance of 0 to 1 as high (75 % or more), medium (50 %) or low."""
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


#: The column that answers a question's field (the names of ``intent.FIELDS``), in the order in which they are looked up.
FIELD_COLUMNS = {
    "NPI number": ("provider_npi", "npi"), "date of birth": ("dob",), "total amount": ("total_amount",), "claim number": ("claim_number",), "patient id": ("patient_mrn", "patient_id"), "address": ("address",), "phone": ("phone",),
    "insurance": ("insurance_id",), "gender": ("gender",), "death time": ("deathtime",), "admission type": ("admission_type",), "discharge time": ("dischtime",), "admit time": ("admittime",),
}
#: Fields of a person rather than of a record.
DEMOGRAPHIC = frozenset(("date of birth", "address", "phone", "insurance", "gender", "patient id"))


def specific_field(field: Column, columns: list[str]) -> Column:
    """The value of the asked field: its own columns first, else the first column whose name holds the field's name."""
    chain = F.lit(None).cast("string")
    for name, own in FIELD_COLUMNS.items():
        some = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in own if c in columns]
        if some:
            chain = F.when(field == name, F.coalesce(*some)).otherwise(chain)
    named = [F.when(F.lit(c.replace("_", " ")).contains(F.lower(field)), F.nullif(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.coalesce(chain, *named)


def with_asked(content: Column, field: Column, value: Column) -> Column:
    """A text with the asked field as its first line, where there is a value."""
    return F.concat_ws("\n", F.when(value.isNotNull() & field.isNotNull(), F.concat(F.lit("["), F.upper(field), F.lit("]: "), value)), content)


def lines(*pairs: tuple[str, str]) -> Column:
    """``label: value`` lines of the columns that hold something."""
    return F.concat_ws("\n", *[_line(label, column) for label, column in pairs])


def provider_text() -> Column:
    return lines(("Provider", "name"), ("NPI", "npi"), ("Specialty", "specialty"), ("Date of birth", "dob"), ("Phone", "phone"), ("Address", "address"), ("License", "license_number"))


def admission_text() -> Column:
    return lines(("Admission (HADM_ID)", "hadm_id"), ("Subject", "subject_id"), ("Admitted", "admittime"), ("Discharged", "dischtime"), ("Died", "deathtime"), ("Admission type", "admission_type"), ("Diagnosis", "diagnosis"))


def demographics_text() -> Column:
    return lines(("Patient", "name"), ("Patient ID", "patient_id"), ("Date of birth", "dob"), ("Gender", "gender"), ("Phone", "phone"), ("Address", "address"), ("Insurance", "insurance_id"))
