"""Names are taken apart again: no two environments, layers or domains share a table."""

from itertools import product

import pytest

from strata.names import ENVIRONMENTS, LAYERS, Workspace, catalog_name, schema_name

SUFFIXES = ("", "raw", "eu_west")


@pytest.mark.parametrize(("env", "suffix"), list(product(ENVIRONMENTS, SUFFIXES)))
def test_catalog_is_its_parts_in_order(env, suffix):
    parts = catalog_name("ferry", env, suffix).split("_")
    assert parts[:2] == ["ferry", env]
    assert "_".join(parts[2:]) == suffix


def test_schema_is_domain_and_layer():
    for domain, layer in product(("port", "crew_list"), LAYERS):
        assert schema_name(domain, layer).rpartition("_")[::2] == (domain, layer)


def test_every_environment_suffix_and_layer_has_its_own_table():
    own = [Workspace("ferry", "port", suffix) for suffix in SUFFIXES]
    shared = [Workspace("ferry", "port", catalog="one"), Workspace("ferry", "crew", catalog="one")]
    tables = [w.table(env, layer, "berths") for w, env, layer in product(own + shared, ENVIRONMENTS, LAYERS)]
    assert len(set(tables)) == len(tables)
    for table in tables:
        catalog, schema, name = table.split(".")
        assert name == "berths" and schema.rpartition("_")[2] in LAYERS
        assert catalog == "one" or catalog.startswith("ferry_")


@pytest.mark.parametrize("env", ["", "Prod", "production", "dev "])
def test_other_environments_are_refused(env):
    for name in (lambda: catalog_name("ferry", env), lambda: Workspace("ferry", "port").table(env, "gold", "t")):
        with pytest.raises(ValueError, match="env must be"):
            name()


def test_other_layers_are_refused():
    with pytest.raises(ValueError, match="layer must be"):
        Workspace("ferry", "port").schema("dev", "platinum")
