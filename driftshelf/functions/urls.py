"""URL normalisation and link resolution."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_UP_TO_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def _tidy(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def url_path(c: Column) -> Column:
    """Path of a URL without its trailing slashes."""
    path = F.regexp_extract(_tidy(c), _UP_TO_PATH + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(_tidy(c), _UP_TO_PATH + r"//([^/?#]*)", 1))


def canonicalize_url(c: Column) -> Column:
    """Lower-case scheme and host; no query, fragment or trailing slash."""
    url = _tidy(c)
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    marked = url.rlike(_UP_TO_PATH + "//")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(marked, F.concat(F.lit("//"), url_host(c))).otherwise(""),
        url_path(c),
    )


def last_segment(c: Column) -> Column:
    """External id: the last path segment."""
    return F.element_at(F.split(url_path(c), "/"), -1)


@F.pandas_udf(StringType())
def _join(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return urljoin(b, h) if b is not None and h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, link)], dtype=object)


def resolve_link(base: Column, link: Column) -> Column:
    """Absolute address of a link by the general rules, through an Arrow batch."""
    return _join(base, link)


def is_simple_link(base: Column, link: Column) -> Column:
    """Links a concat resolves: absolute ones, and root-relative without dot segments."""
    absolute = link.rlike(r"^https?://[^\s]+$")
    rooted = link.rlike(r"^/(?!/)[^\s]*$") & base.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    return F.coalesce((absolute | rooted) & ~link.rlike(r"/\.\.?(/|$|\?|#)"), F.lit(False))


def resolve_simple_link(base: Column, link: Column) -> Column:
    """Resolution of links that pass :func:`is_simple_link`, all in the JVM."""
    origin = F.regexp_extract(_tidy(base), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    return F.when(link.startswith("/"), F.concat(origin, link)).otherwise(link)


def resolve(base: Column, link: Column) -> Column:
    """Absolute address of a link in one pass: Arrow only works on links a concat cannot
    resolve."""
    simple = is_simple_link(base, link)
    hard = resolve_link(base, F.when(~simple, link))
    return F.when(simple, resolve_simple_link(base, link)).otherwise(hard)
