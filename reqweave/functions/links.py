"""Absolute links of HTML pages."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from reqweave.functions.text import first_of, trim_space

# How an href attribute is found, and what a path may hold unescaped.
HREF = r"""(?i)href\s*=\s*['"]([^'"#]+)['"]"""
PATH_SAFE = "$&+,/:;=@-_.~!*()'[]"


def href_values(html: Column) -> Column:
    """Raw href values in page order, blank ones left out."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.filter(F.transform(found, trim_space), lambda h: h != "")


def _absolute(base: str, ref: str) -> str | None:
    try:
        parts = urlsplit(urljoin(base, ref))
    except ValueError:
        return None
    if parts.scheme not in ("http", "https"):
        return None
    path = parts.path if parts.path.isascii() else quote(parts.path, safe=PATH_SAFE + "%")
    return urlunsplit((parts.scheme, parts.netloc, path, parts.query, parts.fragment))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolve(urls: pd.Series, refs: pd.Series) -> pd.Series:
    def one(base, found):
        if found is None:
            return None
        return [link for link in (_absolute(base, ref) for ref in found) if link]

    return pd.Series([one(b, f) for b, f in zip(urls, refs)], dtype=object)


def extract_links(url: Column, html: Column, max_links: int = 0) -> Column:
    """Distinct http(s) links in page order, resolved against the page address; all, or the first ``max_links``."""
    refs = F.array_distinct(href_values(html))
    return first_of(F.array_distinct(_resolve(url, refs)), max_links)
