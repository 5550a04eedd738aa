"""The registered queries: damage made from clean columns, and the SQL that says what should come out."""

from .queries import ORACLE_SQL, QUERIES, flagship  # noqa: F401
