"""Site settings as a table: one row per site, one column per setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteindex import constants as C
from siteindex.functions.urls import blank, normalise_input

RULES = "array<struct<category:string,url_patterns:array<string>,title_patterns:array<string>>>"
SITES = (
    "site_id string, name string, description string, additional_info string, "
    "urls array<string>, include_patterns array<string>, exclude_patterns array<string>, "
    f"category_rules {RULES}, max_pages int, max_depth int, traversal_mode string"
)
SETTINGS = tuple(column.strip().split(" ")[0] for column in SITES.replace(RULES, "x").split(","))
_FILE = SITES.replace("site_id string, ", "").replace(
    RULES, "map<string,struct<url_patterns:array<string>,title_patterns:array<string>>>"
)


def read_sites(spark: SparkSession, path: str, overrides: dict | None = None) -> DataFrame:
    """Sites from JSON configuration files, one file per site, keyed by file address.

    ``overrides`` replaces settings of every site, as options given by hand would;
    empty values do not count. Rules keep the order of the file: the first match wins.
    """
    raw = spark.read.schema(_FILE).json(path, multiLine=True)
    rules = F.transform(
        F.map_entries("category_rules"),
        lambda e: F.struct(
            e["key"].alias("category"),
            e["value"]["url_patterns"].alias("url_patterns"),
            e["value"]["title_patterns"].alias("title_patterns"),
        ),
    )
    sites = raw.withColumn("category_rules", rules).withColumn("site_id", F.input_file_name())
    for name, value in (overrides or {}).items():
        if value:
            setting = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
            sites = sites.withColumn(name, setting)
    return sites.select(*SETTINGS)


def with_defaults(sites: DataFrame) -> DataFrame:
    """Fill settings that are missing with those of the default configuration."""
    return sites.withColumns(
        {
            "name": F.coalesce("name", F.lit(C.DEFAULT_NAME)),
            "description": F.coalesce("description", F.lit(C.DEFAULT_DESCRIPTION)),
            "urls": F.coalesce("urls", F.array(*map(F.lit, C.DEFAULT_URLS))),
            "max_pages": F.coalesce("max_pages", F.lit(C.DEFAULT_MAX_PAGES)),
            "max_depth": F.coalesce("max_depth", F.lit(C.DEFAULT_MAX_DEPTH)),
            "traversal_mode": F.coalesce("traversal_mode", F.lit(C.DEFAULT_MODE)),
        }
    )


def _error() -> Column:
    """First rule that a site breaks, NULL if none."""
    missing = [
        F.when(F.col(key).isNull(), F.lit(f"Missing required configuration key: {key}"))
        for key in ("name", "description", "urls")
    ]
    empty = F.when(F.size("urls") == 0, F.lit("urls must be a non-empty list"))
    return F.coalesce(*missing, empty)


def violations(sites: DataFrame) -> DataFrame:
    """``(site_id, error)`` for each site that cannot be run."""
    return sites.select("site_id", _error().alias("error")).where(F.col("error").isNotNull())


def validated(sites: DataFrame) -> DataFrame:
    """The same sites; the job fails at the first one that cannot be run."""
    error = _error()
    return sites.where(F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.lit(True)))


def requested_sites(requests: DataFrame) -> DataFrame:
    """Sites for typed addresses ``(site_id, url[, is_local])``; blank addresses give none."""
    local = F.col("is_local") if "is_local" in requests.columns else None
    asked = requests.where(~blank(F.col("url"))).withColumn(
        "url", normalise_input(F.col("url"), local)
    )
    return asked.select(
        "site_id",
        F.lit(C.DEFAULT_NAME).alias("name"),
        F.concat(F.lit("Documentation generated from "), "url").alias("description"),
        F.lit(None).cast("string").alias("additional_info"),
        F.array("url").alias("urls"),
        F.array().cast("array<string>").alias("include_patterns"),
        F.array().cast("array<string>").alias("exclude_patterns"),
        F.array().cast(RULES).alias("category_rules"),
        F.lit(C.DEFAULT_MAX_PAGES).alias("max_pages"),
        F.lit(C.DEFAULT_MAX_DEPTH).alias("max_depth"),
        F.lit(C.DEFAULT_MODE).alias("traversal_mode"),
    )
