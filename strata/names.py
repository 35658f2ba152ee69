"""Names of catalogs, schemas and tables per environment and layer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

# The environments and the layers a name can refer to.
ENVIRONMENTS = ("dev", "test", "prod")
LAYERS = ("bronze", "silver", "gold")


def catalog_name(prefix: str, env: str, suffix: str = "") -> str:
    """``prefix_env``, or ``prefix_env_suffix`` when a suffix is given."""
    if env not in ENVIRONMENTS:
        raise ValueError(f"env must be one of {', '.join(ENVIRONMENTS)}, not {env!r}")
    return "_".join(part for part in (prefix, env, suffix) if part)


def schema_name(prefix: str, layer: str) -> str:
    """``prefix_layer``."""
    return f"{prefix}_{layer}"


@dataclass(frozen=True)
class Workspace:
    """Where the tables of one data domain live, and in which format.

    By default each environment has its own catalog. With ``catalog`` set, all
    environments share that catalog and the environment moves into the schema
    name, so that they still never mix.
    """

    catalog_prefix: str
    schema_prefix: str
    catalog_suffix: str = ""
    catalog: str | None = None
    format: str = "parquet"

    def schema(self, env: str, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"layer must be one of {', '.join(LAYERS)}, not {layer!r}")
        own_catalog = catalog_name(self.catalog_prefix, env, self.catalog_suffix)
        if self.catalog:
            return f"{self.catalog}.{schema_name(f'{self.schema_prefix}_{env}', layer)}"
        return f"{own_catalog}.{schema_name(self.schema_prefix, layer)}"

    def table(self, env: str, layer: str, table: str) -> str:
        return f"{self.schema(env, layer)}.{table}"

    def create_schemas(self, spark: SparkSession, env: str, location: str | None = None) -> None:
        """Create the schema of every layer, under ``location`` if it is given."""
        for layer in LAYERS:
            place = f" LOCATION '{location}/{layer}'" if location else ""
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.schema(env, layer)}{place}")
