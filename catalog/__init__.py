"""Named queries over the test tables, each with the SQL that must give the same rows."""

from catalog import charts, ingestion, outcomes, prevalence, registry, scalars

MODULES = [prevalence, outcomes, charts, scalars, ingestion, registry]


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
