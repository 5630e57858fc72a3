"""Canonical spellings of page ids, splits and sources, as the core has them."""

from foliolake.functions.pages import IMAGE_ENDING, page_id, page_kind, source_name, split_name

__all__ = ["IMAGE_ENDING", "page_id", "page_kind", "source_name", "split_name"]
