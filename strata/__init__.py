"""Layered batch tables on Spark: ingest, clean, summarise and check."""

from strata.names import Workspace, catalog_name, schema_name
from strata.session import SETTINGS, configure, shared_folder, sized_session

__all__ = [
    "SETTINGS",
    "Workspace",
    "catalog_name",
    "configure",
    "schema_name",
    "shared_folder",
    "sized_session",
]
