"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from latticeq.plans import interfaces, relational, structural

QUERIES: dict = relational.QUERIES | structural.QUERIES | interfaces.QUERIES
SQL: dict = relational.SQL | structural.SQL | interfaces.SQL
