"""Readers and writers of tables and files."""

from quern.sources.tables import spread, table

__all__ = ["spread", "table"]
