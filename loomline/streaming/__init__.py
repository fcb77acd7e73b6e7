"""Streams over event tables, run to the end of their input."""
