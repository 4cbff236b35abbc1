"""Catalogue of runnable queries, one per capability."""

from gyrespark.plans.catalog import base
from gyrespark.plans.catalog import aggregates, fields, identification, joins_skill, partitions, scalars, windows  # noqa: F401

QUERIES = base.QUERIES
