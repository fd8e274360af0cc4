"""Data-quality rules declared by the grant schema (row-local, no shuffle
except the key-uniqueness and foreign-key checks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantflow.functions.text import labels
from grantflow.schema import REQUIRED_GRANT_FIELDS, ROLES

# Shapes of codes and identifiers.
CURRENCY_RE = r"^[A-Z]{3}$"
COUNTRY_RE = r"^[A-Z]{2}$"
URL_RE = r"^https?://"


def normalise_role(c: Column) -> Column:
    """``co-lead`` (schema spelling) -> ``co-lead_investigator`` (vocabulary)."""
    return F.when(F.lower(c) == "co-lead", F.lit("co-lead_investigator")).otherwise(c)


def violation_checks(required=REQUIRED_GRANT_FIELDS) -> list[Column]:
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    checks += [
        F.when(F.col("amount").isNotNull() & F.col("currency").isNull(), F.lit("currency_missing")),
        F.when(~F.col("currency").rlike(CURRENCY_RE), F.lit("currency_format")),
        F.when(~F.col("country_code").rlike(COUNTRY_RE), F.lit("country_format")),
        F.when(~normalise_role(F.col("investigator_role")).isin(*ROLES), F.lit("role_invalid")),
        F.when(~F.col("investigator_ORCID").rlike(URL_RE), F.lit("orcid_not_url")),
        F.when(~F.col("ROR").rlike(URL_RE), F.lit("ror_not_url")),
    ]
    return checks


def validate(grants: DataFrame) -> DataFrame:
    """Adds ``violations`` (array<string>, empty when valid) and ``null_amount``."""
    return grants.withColumns({
        "violations": labels(*violation_checks()),
        "null_amount": F.col("amount").isNull(),
    })


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Primary-key values that occur more than once, with their count."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Child rows whose non-null foreign key has no parent (null FK is allowed)."""
    pk = pk or fk
    keys = parent.select(F.col(pk).alias("__pk")).distinct()
    return (child.filter(F.col(fk).isNotNull())
            .join(keys, F.col(fk) == F.col("__pk"), "left_anti"))
