"""Flat grants <-> relational model (grant_project, organization,
investigator, grant_party link table).

Surrogate keys are SHA-256 of the identifying attributes joined by the
unit separator, nulls spelled ``\\u0001`` so that (a, null) and (null, a)
differ: text where they are shown as ids, 32 bytes where tables link.  A link
key covers every attribute, so distinct rows are found by the key alone, combine
map-side, and lie where the join on that key needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantflow.session import staged

SEP = "\u001f"
NULL_MARK = "\u0001"

ORG_ATTRS = ["organization_name", "ROR", "country_code"]
PERSON_ATTRS = ["investigator_given_name", "investigator_family_name",
                "investigator_ORCID", "investigator_role"]
GRANT_ATTRS = ["grant_id", "DOI", "resource", "project_title", "project_description",
               "funder_name", "funder_id", "funding_type", "funding_scheme",
               "internal_award_number", "start_date", "end_date", "amount", "currency",
               "funding_percentage"]


def surrogate_key(*cols: str | Column) -> Column:
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_MARK))
             for c in cols]
    return F.sha2(F.concat_ws(SEP, *parts), 256)


def link_key(*cols: str | Column) -> Column:
    return F.unhex(surrogate_key(*cols))


def with_keys(grants: DataFrame) -> DataFrame:
    """Adds organization_id and investigator_id where absent, and the keys by
    which rows link.

    A key covers every attribute of its entity, its given id included, so
    rows that differ in anything are different entities and none replaces
    another; :func:`conflicts` reports ids that stand for several.
    """
    org_id = F.when(F.col("organization_name").isNotNull(), surrogate_key(*ORG_ATTRS))
    person_id = F.when(
        F.coalesce(*[F.col(c) for c in PERSON_ATTRS[:3]]).isNotNull(),
        surrogate_key(*PERSON_ATTRS, "organization_name"))
    ids = grants.withColumns({
        "organization_id": F.coalesce(F.col("organization_id"), org_id),
        "investigator_id": F.coalesce(F.col("investigator_id"), person_id),
    })
    return ids.withColumns({
        "grant_project_id": link_key(*GRANT_ATTRS),
        "organization_key": F.when(F.coalesce("organization_id", *ORG_ATTRS).isNotNull(),
                                   link_key("organization_id", *ORG_ATTRS)),
        "investigator_key": F.when(F.coalesce("investigator_id", *PERSON_ATTRS).isNotNull(),
                                   link_key("investigator_id", "organization_id", *PERSON_ATTRS)),
    })


def organizations(keyed: DataFrame) -> DataFrame:
    return (keyed.filter(F.col("organization_key").isNotNull())
            .select("organization_key", "organization_id", F.col("organization_name").alias("name"),
                    "ROR", "country_code").dropDuplicates(["organization_key"]))


def investigators(keyed: DataFrame) -> DataFrame:
    return (keyed.filter(F.col("investigator_key").isNotNull())
            .select("investigator_key", "investigator_id", "organization_id",
                    F.col("investigator_role").alias("role"),
                    F.col("investigator_given_name").alias("given_name"),
                    F.col("investigator_family_name").alias("family_name"),
                    F.lit(None).cast("string").alias("alternate_name"),
                    F.col("investigator_ORCID").alias("ORCID")).dropDuplicates(["investigator_key"]))


def grant_projects(keyed: DataFrame) -> DataFrame:
    return keyed.select("grant_project_id", F.col("grant_id").alias("award_number"),
                        *[c for c in GRANT_ATTRS if c != "grant_id"]).dropDuplicates(["grant_project_id"])


def grant_parties(keyed: DataFrame) -> DataFrame:
    """Links with their number of flat rows, so repeated rows come back."""
    return keyed.groupBy("grant_project_id", "organization_key", "investigator_key") \
                .agg(F.count(F.lit(1)).alias("n_rows"))


def conflicts(table: DataFrame, id_col: str) -> DataFrame:
    """Ids under which a relational table holds rows that differ."""
    return (table.filter(F.col(id_col).isNotNull()).groupBy(id_col)
            .agg(F.count(F.lit(1)).alias("n_versions")).where("n_versions > 1"))


def normalise(grants: DataFrame, materialize: bool = False) -> dict[str, DataFrame]:
    """The four relational tables.  With ``materialize`` the keyed rows are
    staged once, so that the four tables read only their own columns of them
    instead of recomputing the input."""
    keyed = with_keys(grants)
    if materialize:
        keyed = staged(keyed, "model-keyed")
    return {
        "grant_project": grant_projects(keyed),
        "organization": organizations(keyed),
        "investigator": investigators(keyed),
        "grant_party": grant_parties(keyed),
    }


def write_bucketed(tables: dict[str, DataFrame], name: str, path: str, buckets: int) -> dict[str, DataFrame]:
    """Save the relational tables as ``<name>_<table>`` below ``path``, those
    that hold grants bucketed and sorted by the grant key.

    Both sides of the largest join then lie as it needs them: reassembly reads
    bucket by bucket, with no exchange on the grant key and no sort.  Take as
    many buckets as give files of a few hundred MB; rows that a grant links
    stay together, so the number bounds no task's groups but the grant's own.
    """
    spark = tables["grant_party"].sparkSession
    out = {}
    for table, df in tables.items():
        full, writer = f"{name}_{table}", df.write
        if "grant_project_id" in df.columns:
            writer = df.repartition(buckets, "grant_project_id").write \
                .bucketBy(buckets, "grant_project_id").sortBy("grant_project_id")
        writer.format("parquet").option("path", f"{path}/{table}").saveAsTable(full)
        out[table] = spark.table(full)
    return out


def _left_on_key(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join in which rows without a key are spread by their grant: a key
    made of it matches nothing, where nulls would all meet in one partition."""
    own = F.coalesce(F.col(key), F.concat(F.lit(b"-"), F.col("grant_project_id")))
    return rows.withColumn("__key", own).join(side.withColumnRenamed(key, "__key"), "__key", "left").drop("__key")


def reassemble(tables: dict[str, DataFrame]) -> DataFrame:
    """grant_project ⋈ grant_party ⟕ organization ⟕ investigator -> flat rows.

    All joins are equi-joins on surrogate keys; AQE picks broadcast for the
    small dimension sides at runtime and splits skewed key partitions.  Tables
    of :func:`write_bucketed` join on the grant key where they lie.
    """
    out = tables["grant_party"].join(tables["grant_project"], "grant_project_id")
    out = _left_on_key(out, tables["organization"], "organization_key")
    out = _left_on_key(out, tables["investigator"].drop("organization_id"), "investigator_key")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).select(
        F.col("award_number").alias("grant_id"),
        *[c for c in GRANT_ATTRS if c != "grant_id"],
        "organization_id", F.col("name").alias("organization_name"), "ROR", "country_code",
        "investigator_id", F.col("role").alias("investigator_role"),
        F.col("given_name").alias("investigator_given_name"),
        F.col("family_name").alias("investigator_family_name"),
        F.col("ORCID").alias("investigator_ORCID"),
    )
