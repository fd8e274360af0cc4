"""Declared schemas, the grant vocabulary and the conform crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: field names and their order.
# ---------------------------------------------------------------------------

# Canonical flat grant schema (one wide row per grant x organization x person).
AMOUNT_TYPE = T.DecimalType(20, 2)
PERCENT_TYPE = T.DecimalType(7, 4)

GRANT_FIELDS: list[tuple[str, T.DataType]] = [
    ("grant_id", T.StringType()),
    ("DOI", T.StringType()),
    ("resource", T.StringType()),
    ("project_title", T.StringType()),
    ("project_description", T.StringType()),
    ("funder_name", T.StringType()),
    ("funder_id", T.StringType()),
    ("funding_type", T.StringType()),
    ("funding_scheme", T.StringType()),
    ("internal_award_number", T.StringType()),
    ("start_date", T.DateType()),
    ("end_date", T.DateType()),
    ("amount", AMOUNT_TYPE),
    ("currency", T.StringType()),
    ("funding_percentage", PERCENT_TYPE),
    ("organization_id", T.StringType()),
    ("organization_name", T.StringType()),
    ("ROR", T.StringType()),
    ("country_code", T.StringType()),
    ("investigator_id", T.StringType()),
    ("investigator_role", T.StringType()),
    ("investigator_given_name", T.StringType()),
    ("investigator_family_name", T.StringType()),
    ("investigator_ORCID", T.StringType()),
]
GRANT_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in GRANT_FIELDS])
GRANT_COLUMNS = [n for n, _ in GRANT_FIELDS]

# Relational model (grant_project / organization / investigator + link table).
GRANT_PROJECT_COLUMNS = [
    "grant_project_id", "award_number", "DOI", "resource", "project_title",
    "project_description", "funder_name", "funder_id", "funding_type",
    "funding_scheme", "internal_award_number", "start_date", "end_date",
    "amount", "currency", "funding_percentage",
]
ORGANIZATION_COLUMNS = ["organization_id", "name", "ROR", "country_code"]
INVESTIGATOR_COLUMNS = [
    "investigator_id", "organization_id", "role", "given_name", "family_name",
    "alternate_name", "ORCID",
]

# Required grant fields (schema "mandatory" flags); currency only when amount.
REQUIRED_GRANT_FIELDS = [
    "grant_id", "DOI", "resource", "project_title", "funder_name", "funder_id",
    "funding_type", "internal_award_number",
]

# ---------------------------------------------------------------------------
# Vocabulary, word lists, headers and mappings.
# ---------------------------------------------------------------------------

# Grant vocabulary in declared order: (key, description, limits).  Two keys
# are declared twice; as with a mapping literal, the later text wins and the
# first position stays (see ``vocabulary_rows``).
VOCABULARY_DECLARED = [
    ("project", "Container for project information. Multiple projects may be assigned to a single Grant ID.", "required; multiple allowed"),
    ("project-title", "Title of a project funded by the grant being registered", "required; multiple allowed"),
    ("description", "Used to capture an abstract or description of a project.", "optional; multiple allowed"),
    ("@xml:lang", "Use @xml:lang to identify language for each project-title or description.", "optional"),
    ("investigators", "Container for investigator information", "optional"),
    ("person", "Container for individual investigator details", "at least 1 required, multiple allowed (unbounded)"),
    ("@role", "Available roles are lead_investigator, co-lead_investigator, investigator", "required"),
    ("@start-date", "Date an investigator began work with the project", "optional"),
    ("@end-date", "Date an investigator ended work with the project", "optional"),
    ("givenName", "Given or first name", "optional"),
    ("familyName", "Family or surname", "optional"),
    ("alternateName", "Alias or nickname used by the Investigator", "optional"),
    ("affiliation", "Container for affiliation information", "optional, multiple allowed"),
    ("institution", "Institution an investigator is affiliated with when associated with the project being defined.", "1 allowed, use multiple affiliation groups for investigators with multiple affiliations"),
    ("@country", "ISO 3166-1 alpha 2-letter country code, captures location (country) of affiliation", "optional"),
    ("ROR", "A ROR ID may be supplied to disambiguate affiliation information, expressed as a URL", "optional"),
    ("ORCID", "ORCID ID of the investigator, expressed as a URL", "optional"),
    ("award-amount", "Total overall amount awarded to project", "optional"),
    ("@currency", "ISO 4217 currency for value provided in award-amount", "required"),
    ("funding", "Container for funding information. Use multiple funding sections as needed to specify different funding types", "required, multiple allowed"),
    ("@amount", "Amount of funding provided by funder", "optional"),
    ("@funding-percentage", "Percentage of overall funding", "optional"),
    ("@funding-type", "Type of funding provided, values are limited", "required"),
    ("@null-amount", "Supply for projects where an award amount is missing or can’t be disclosed", "optional"),
    ("funder-name", "Name of the funder", "required"),
    ("funder-id", "Funder identifier from the Funder Registry", "required"),
    ("funding-scheme", "Scheme for grant or award as provided by the funder", "optional"),
    ("award-dates", "Container for date information", "optional"),
    ("@start-date", "Actual start date of award", "optional"),
    ("@end-date", "Actual end date of the award", "optional"),
    ("@planned-start-date", "Planned start date of award", "optional"),
    ("@planned-end-date", "Planned end date of award", "optional"),
    ("award-number", "Funder-supplied award ID / grant number", "required"),
    ("award-start-date", "Start date of grant funding", "optional"),
    ("relation", "Relationship metadata connecting grant to other items (other grants, funded research outputs)", "optional"),
    ("DOI", "DOI being registered", "required"),
    ("resource", "URL of grant landing page", "required"),
]

# Roles allowed for investigators (vocabulary spelling).
ROLES = ["lead_investigator", "co-lead_investigator", "investigator"]

# Strings the pandas CSV reader treats as missing by default (pandas 2.2).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Catalog CSV: required headers, optional headers with their defaults.
CATALOG_REQUIRED = ["Funder", "Source_name", "Country", "Type", "Link to dump", "Format"]
CATALOG_OPTIONAL = ["Action", "Status", "Link to web", "Size", "Notes", "skip_ssl_verify"]
CATALOG_STATUS_DEFAULT = "Not started"

# Strings read as true by the flag parser (case-insensitive).
TRUTHY = ["true", "1", "yes", "y", "t"]

# Prototype conform mapping for the wide landing layout, in declared order.
# A dict value is a compound target: one source column feeds several fields.
PROTOTYPE_MAPPING = [
    ("Research Project Title", "project_title"),
    ("Project Title (English)", "project_title"),
    ("Project/Area Number", "grant_id"),
    ("Project Period (FY)", {"start_date": "start_date", "end_date": "end_date"}),
    ("Principal Investigator", {"given_name": "investigator_given_name", "family_name": "investigator_family_name"}),
    ("Research Institution", "organization_name"),
    ("Total Cost (Overall)", "amount"),
    ("Keywords", "project_description"),
]

# Separator of a "start – end" period (spaced en dash).
PERIOD_SEPARATOR = " – "

# Vocabulary key -> flat field, best key first where several feed one field.
CROSSWALK = {
    "grant_id": ["award-number"],
    "DOI": ["DOI"],
    "resource": ["resource"],
    "project_title": ["project-title"],
    "project_description": ["description"],
    "funder_name": ["funder-name"],
    "funder_id": ["funder-id"],
    "funding_scheme": ["funding-scheme"],
    "funding_type": ["@funding-type"],
    "amount": ["award-amount", "@amount"],
    "currency": ["@currency"],
    "funding_percentage": ["@funding-percentage"],
    "start_date": ["award-start-date", "@start-date", "@planned-start-date"],
    "end_date": ["@end-date", "@planned-end-date"],
    "organization_name": ["institution"],
    "ROR": ["ROR"],
    "country_code": ["@country"],
    "investigator_role": ["@role"],
    "investigator_given_name": ["givenName"],
    "investigator_family_name": ["familyName"],
    "investigator_ORCID": ["ORCID"],
}


def vocabulary_rows() -> list[tuple[int, str, str, str]]:
    """Distinct vocabulary as ``(ord, key, description, limits)``.

    First position kept, last text wins — 35 distinct keys.
    """
    order: dict[str, int] = {}
    text: dict[str, tuple[str, str]] = {}
    for key, desc, limits in VOCABULARY_DECLARED:
        order.setdefault(key, len(order))
        text[key] = (desc, limits)
    return [(order[k], k, text[k][0], text[k][1]) for k in order]


VOCABULARY_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("limits", T.StringType(), False),
])


def vocabulary_df(spark: SparkSession) -> DataFrame:
    """The vocabulary as a 35-row DataFrame (fixed size: always broadcastable)."""
    return spark.createDataFrame(vocabulary_rows(), VOCABULARY_SCHEMA)
