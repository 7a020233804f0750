"""Sources, sinks and text forms."""

from tessera.sources.csv_dialect import parse_records, read_csv, write_csv
from tessera.sources.rowgroups import read_rowgroups, write_rowgroups
from tessera.sources.schema_text import format_schema, parse_schema, read_schema, write_schema
from tessera.sources.text import parse_date, parse_timestamp, to_text

__all__ = [
    "format_schema", "parse_date", "parse_records", "parse_schema", "parse_timestamp", "read_csv", "read_rowgroups",
    "read_schema", "to_text", "write_csv", "write_rowgroups", "write_schema",
]
