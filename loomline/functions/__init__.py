"""Column functions for vectors, pages, feeds and text."""

from .feeds import feed_items
from .html import page_text, page_title
from .vectors import cosine, dot

__all__ = ["cosine", "dot", "feed_items", "page_text", "page_title"]
