"""Readers and writers: tables, text formats, partitioned output, file streams."""

from .tables import SCHEMAS, read, read_stream, round_trip, write_partitioned

__all__ = ["SCHEMAS", "read", "read_stream", "round_trip", "write_partitioned"]
