"""Text clean-up as Catalyst expressions, with one class of white space for all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOISE_PHRASES = ["the quick brown fox jumps over the lazy dog", "lorem ipsum"]
TRIMMED_MARKS = ".!?\"'`)([]{}<>“”‘’ \t"
IMAGE_SUFFIXES = ["avif", "bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
NON_CONTENT = ["image", "empty_line", "signature_line", "list_marker"]
FENCE = r"(?i)```(?:json)?\s*(\[[\s\S]*?\]|\{[\s\S]*?\})\s*```"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def lines(x: Column) -> Column:
    """Non-blank lines without surrounding white space; none for null."""
    made = F.filter(F.transform(F.split(x, "\n", -1), strip), lambda s: s != "")
    return F.coalesce(made, F.array().cast("array<string>"))


def lines_of_items(x: Column) -> Column:
    """The same of a list whose items may hold several lines."""
    return F.flatten(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda s: lines(F.coalesce(s, F.lit("")))))


def without_front_matter(x: Column) -> Column:
    """The body after a header between two lines of three dashes; the text as it was without a whole header."""
    started = F.regexp_replace(x, f"^{SPACE}+", "")
    rest = F.substring(started, 4, 1 << 30)
    close = F.instr(rest, "\n---")
    body = F.substring(rest, close + 4, F.lit(1 << 30))
    return F.when(F.startswith(started, F.lit("---")) & (close > 0), strip(F.regexp_replace(body, "^\n+", ""))).otherwise(x)


def joined(x: Column) -> Column:
    """The text of a crop in one line."""
    return F.array_join(lines(without_front_matter(x)), " ")


def is_noise(x: Column) -> Column:
    """Whether a text is nothing but a phrase that models fall back to."""
    return F.btrim(F.lower(strip(x)), F.lit(TRIMMED_MARKS)).isin(NOISE_PHRASES)


def crop_text(x: Column) -> Column:
    one = joined(x)
    return F.when(is_noise(one), F.lit("")).otherwise(one)


def dedup_form(x: Column) -> Column:
    return strip(F.regexp_replace(F.lower(x), f"{SPACE}+", " "))


def evaluation_form(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(x), r"[*_`#-]+", " "), f"{SPACE}+", " "))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)).isin(IMAGE_SUFFIXES)


def output_path(path: Column, given: Column) -> Column:
    """Where the result goes: as given, or beside the input."""
    own = F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("_ocr.pdf"))
    return F.coalesce(F.nullif(given, F.lit("")), own)


def snippet(x: Column, n: int) -> Column:
    return F.replace(F.substring(x, 1, n), F.lit("\n"), F.lit(" "))


def page_numbers(spec: Column, total: Column) -> Column:
    """Pages from 0 of a list such as 1-3,5: in order, once each, none that don't exist; a bad number raises."""
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")

    def expand(p: Column) -> Column:
        a = strip(F.substring_index(p, "-", 1)).cast("int")
        b = strip(F.when(F.contains(p, F.lit("-")), F.regexp_extract(p, "^[^-]*-(.*)$", 1)).otherwise(p)).cast("int")
        lo, hi = F.greatest(a, F.lit(1)), F.least(b, total)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))
    return F.transform(pages, lambda p: p - 1)
