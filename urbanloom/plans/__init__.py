"""Registry of the analytics queries: name -> callable(spark, sf_dir), and the SQL that each must equal."""

from urbanloom.plans import city, decision, formulas, hazards, models, planning, ranking, services, statistics, streets, structure, surface  # noqa: F401
from urbanloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
