"""Header contracts of the tables that the library reads and writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

#: The parts of a row's key, the labels of blocks.
ROW_KEY = ("record_kind", "page_index", "block_index", "line_index", "next_page_index", "next_block_index", "next_line_index")
BLOCK_LABELS = ("paragraph", "heading", "table_like", "form_row", "list_item", "caption", "footer_header_noise", "separator", "link_text", "keep_as_text")
#: Older label names and what they are called now.
LEGACY_LABELS = {
    "BodyText": "paragraph", "Heading": "heading", "Noise": "footer_header_noise", "PageNumber": "footer_header_noise",
    "HeaderFooter": "footer_header_noise", "Caption": "caption", "TableLike": "table_like", "Unknown": "keep_as_text",
}


def require_columns(df: DataFrame, names: Iterable[str], exact: bool = False) -> DataFrame:
    """df, if its header has (exactly, in order) the names; also right for tables without rows."""
    names = list(names)
    if exact and df.columns != names:
        raise ValueError(f"header is {df.columns}, not {names}")
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def feature_columns(df: DataFrame, reserved: Iterable[str]) -> list[str]:
    """Every column that is not reserved, in table order."""
    kept = set(reserved)
    return [c for c in df.columns if c not in kept]


def with_default_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with every named column; absent ones are 0 (or false) of their type."""
    return df.selectExpr("*", *[f"cast(0 as {kind}) as `{c}`" for c, kind in kinds.items() if c not in df.columns])
