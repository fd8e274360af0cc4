"""Catalog operators: action expansion, funder grouping, parser settings,
format dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Per-parser reader settings.
PARSER_SETTINGS = [
    # parser, encoding, delimiter, quotechar, date_format, sheet_name, pagination, rate_limit, wait_time
    ("standard_csv", "utf-8", ",", '"', "%Y-%m-%d", None, None, None, None),
    ("excel", None, None, None, "%Y-%m-%d", 0, None, None, None),
    ("api", None, None, None, None, None, False, 60, None),
    ("html", None, None, None, None, None, None, None, 2),
]
PARSER_SETTINGS_SCHEMA = (
    "parser string, encoding string, delimiter string, quotechar string, "
    "date_format string, sheet_name int, pagination boolean, rate_limit int, wait_time int"
)

# Formats each reader accepts; anything else fails as unsupported.
FILE_FORMATS = ["csv", "excel", "xlsx", "xls"]
PROJECT_API_TAG = "openaire"

ACTION_TYPE = "array<struct<name:string,data_link:string>>"


def parser_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARSER_SETTINGS, PARSER_SETTINGS_SCHEMA)


def with_parser_settings(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """sources ⟕ parser settings on ``parser`` (4-row fixed table: broadcast)."""
    return sources.join(F.broadcast(parser_settings(spark)), "parser", "left")


def expand_actions(df: DataFrame, actions: str, single_action: str, data_link: str) -> DataFrame:
    """One row per action to fetch.

    Entries missing a name or a link are dropped; with no valid entry the
    source's own action is used, else the empty action.
    """
    valid = F.filter(F.col(actions), lambda a: F.coalesce(a["name"] != "", F.lit(False))
                     & a["data_link"].isNotNull())
    single = F.array(F.struct(F.coalesce(F.col(single_action), F.lit("")).alias("name"),
                              F.col(data_link).alias("data_link")))
    chosen = F.when(F.coalesce(F.size(valid), F.lit(0)) > 0, valid).otherwise(single)
    return (df.select("*", F.explode(chosen).alias("__a"))
              .select(*[c for c in df.columns if c != actions],
                      F.col("__a.name").alias("action_name"),
                      F.col("__a.data_link").alias("action_link")))


def funder_key(funder: Column) -> Column:
    return F.replace(funder, F.lit(" "), F.lit("_"))


def group_actions(df: DataFrame, funder: str, action: str, data_link: str) -> DataFrame:
    """Distinct actions per funder key, one row each (``funder_key, name,
    data_link``): a funder's links are not bounded, so they are not one array."""
    return (df.filter(F.col(funder).isNotNull() & (F.col(funder) != "")
                       & F.col(action).isNotNull() & (F.col(action) != ""))
               .select(funder_key(F.col(funder)).alias("funder_key"),
                       F.col(action).alias("name"), F.col(data_link).alias("data_link"))
               .distinct())


def dispatch(fmt: Column, source_id: Column, url: Column) -> Column:
    """Reader route per source: project_api / api / file / html / unsupported."""
    f = F.lower(F.coalesce(fmt, F.lit("")))
    tagged = (F.lower(F.coalesce(source_id, F.lit(""))).contains(PROJECT_API_TAG)
              | F.lower(F.coalesce(url, F.lit(""))).contains(PROJECT_API_TAG))
    return (F.when(f.isin(*FILE_FORMATS), "file")
            .when((f == "api") & tagged, "project_api")
            .when(f == "api", "api")
            .when(f == "html", "html")
            .otherwise("unsupported"))
