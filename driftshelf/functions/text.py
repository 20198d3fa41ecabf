"""Text clean-up and text-to-value rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode blank (``trim`` only knows U+0020)."""
    return F.regexp_replace(c, _BLANKS, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return blank_to_null(strip(c))


def first_filled(*cs: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def truncate(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """Regex group of the first match, null when there is none.

    Refers to ``c`` once, so that rules built on it do not evaluate it again and again.
    """
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def price_text(c: Column) -> Column:
    """First number in a text, as plain decimal text without commas.

    A lone comma before the number is the first match and yields null.
    """
    digits = F.replace(extract(c, fixed.PRICE_PATTERN), F.lit(","), F.lit(""))
    whole = F.regexp_replace(digits, r"^(?<sign>-?)\.", "${sign}0.")
    plain = F.regexp_replace(whole, r"^(?<sign>-?)0+(?=\d)", "${sign}")
    return extract(plain, r"^-?\d.*$")


def to_decimal(c: Column, precision: int = 14, scale: int = 2) -> Column:
    """Decimal text to a rounded decimal; null when it does not fit."""
    return c.try_cast(f"decimal({precision},{scale})")


def price(c: Column) -> Column:
    return to_decimal(price_text(c))


def first_count(c: Column) -> Column:
    """First digit run of a text with its commas dropped; no digits give 0."""
    digits = extract(F.replace(c, F.lit(","), F.lit("")), r"[0-9]+")
    return F.coalesce(digits, F.lit("0")).try_cast("int")


def comma_count(c: Column) -> Column:
    """First run of digits and commas as a number; no run gives 0, commas alone null."""
    run = F.coalesce(extract(c, r"[0-9,]+"), F.lit("0"))
    return F.replace(run, F.lit(","), F.lit("")).try_cast("int")


def product_code(c: Column) -> Column:
    """Ten-character product code: the whole text, or the code in a product path."""
    whole = strip(c)
    return F.when(whole.rlike(fixed.CODE_PATTERN), F.upper(whole)).otherwise(
        F.upper(extract(c, fixed.CODE_IN_PATH_PATTERN, 1))
    )


def is_code(c: Column) -> Column:
    return c.rlike(fixed.CODE_PATTERN)


def product_url(code: Column, prefix: str = fixed.STYLE_B_URL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), code)


def clean_brand(c: Column) -> Column:
    return strip(F.regexp_replace(c, fixed.BRAND_AFFIX_PATTERN, ""))


def first_word(c: Column) -> Column:
    return F.split(strip(c), r"(?U)\s+")[0]


def split_list(c: Column) -> Column:
    """Comma list to trimmed, non-empty parts."""
    parts = F.transform(F.split(c, ","), strip)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def highlight_lines(lines: Column) -> Column:
    kept = F.filter(
        F.transform(lines, strip),
        lambda x: (x != "") & ~F.lower(x).contains(fixed.MORE_DETAILS_LINE),
    )
    return F.coalesce(kept, F.array().cast("array<string>"))


def join_blocks(blocks: Column) -> Column:
    """Distinct non-empty blocks with a blank line between; null when none."""
    filled = F.filter(blocks, lambda x: x.isNotNull() & (x != ""))
    return blank_to_null(F.array_join(F.array_distinct(filled), "\n\n"))


def join_cells(cells: Column) -> Column:
    """Value of a table row: the cells after the first; null with fewer than two."""
    return F.when(F.size(cells) >= 2, F.array_join(F.slice(cells, 2, F.size(cells)), " | "))


def item(values: Column, position: int) -> Column:
    return F.try_element_at(values, F.lit(position))


def category_second(parts: Column) -> Column:
    return item(parts, 2)


def category_last(parts: Column) -> Column:
    return F.when(F.size(parts) > 1, item(parts, -1))


def without_home(parts: Column) -> Column:
    return F.filter(
        F.transform(parts, strip), lambda x: (x != "") & (F.lower(x) != fixed.BREADCRUMB_HOME)
    )


def stock_from_schema(c: Column) -> Column:
    """Stock status from a structured-data availability value (absent counts as in stock)."""
    sold_out = F.lower(F.coalesce(c, F.lit(""))).contains("outofstock")
    return F.when(sold_out, "out_of_stock").otherwise("in_stock")


def stock_from_text(c: Column) -> Column:
    """Stock status from the availability line of a page."""
    sold_out = F.lower(F.coalesce(c, F.lit(""))).contains(fixed.UNAVAILABLE_WORD)
    return F.when(sold_out, "out_of_stock").otherwise("in_stock")


def review_date_text(c: Column) -> Column:
    return extract(c, fixed.REVIEW_DATE_PATTERN, 1)


def review_date(c: Column) -> Column:
    return F.try_to_date(review_date_text(c), fixed.REVIEW_DATE_FORMAT)


def full_size_image(c: Column) -> Column:
    """Image address without the size token before its extension."""
    return F.regexp_replace(c, fixed.SIZE_TOKEN_PATTERN, ".$1")


def spec_value(specs: Column, name: str) -> Column:
    """Value of a named specification; of several, the last in sort order."""
    named = F.filter(F.array_sort(specs), lambda s: F.lower(s["name"]) == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def block_marker(
    title: Column, body: Column, markers: tuple[str, ...] = fixed.BLOCK_MARKERS, opening: int | None = None
) -> Column:
    """The first marker in the title or the body, else null.

    ``opening`` limits the search to so many characters of the body.
    """
    body = F.coalesce(body, F.lit(""))
    searched = body if opening is None else F.substring(body, 1, opening)
    seen = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(searched))
    return F.coalesce(*[F.when(seen.contains(m), F.lit(m)) for m in markers])
