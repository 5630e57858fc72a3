"""Canonical spellings of page ids, splits and sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_ENDING = r"\s*\.(jpe?g|png|gif|bmp|tiff?|webp)\s*$"


def page_id(col: Column) -> Column:
    """Lower case, no outer blanks or image ending, one hyphen as separator; blank is null."""
    bare = F.regexp_replace(F.lower(F.trim(col)), IMAGE_ENDING, "")
    hyphens = F.regexp_replace(bare, r"[\s_\-]+", "-")
    return F.when(hyphens != "", hyphens)


def page_kind(page: Column) -> Column:
    """The page kind before the number: the source of a crop."""
    return F.regexp_extract(page, r"^(.*?)-?[0-9]*$", 1)


def split_name(col: Column) -> Column:
    """train, val or test; anything else is null."""
    s = F.lower(F.trim(col))
    return (
        F.when(s.isin("train", "training", "trn"), "train")
        .when(s.isin("val", "valid", "validation", "dev"), "val")
        .when(s.isin("test", "testing", "tst"), "test")
    )


def source_name(col: Column) -> Column:
    """Lower case with underscores; blank is null."""
    s = F.regexp_replace(F.lower(F.trim(col)), r"[\s\-_]+", "_")
    return F.when(s != "", s)


#: The same spellings in SQL, for the queries' equivalents.
PAGE_SQL = r"""nullif(regexp_replace(regexp_replace(lower(trim({0})), '\s*\.(jpe?g|png|gif|bmp|tiff?|webp)\s*$', ''), '[\s_\-]+', '-', 'g'), '')"""
SPLIT_SQL = """case when lower(trim({0})) in ('train','training','trn') then 'train'
 when lower(trim({0})) in ('val','valid','validation','dev') then 'val'
 when lower(trim({0})) in ('test','testing','tst') then 'test' end"""
