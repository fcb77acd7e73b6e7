"""Relational operators that Spark has no single call for, on plain DataFrames."""

from .inequality import inequality_counts, prefix_sums
from .joins import as_of_join, interval_join
from .overlaps import overlap_join
from .search import build_index, nearest_neighbours, open_index
from .shaping import distinct_on, qualify, top_per_group, unpivot

__all__ = ["as_of_join", "build_index", "distinct_on", "inequality_counts", "interval_join", "nearest_neighbours", "open_index", "overlap_join", "prefix_sums", "qualify", "top_per_group", "unpivot"]
