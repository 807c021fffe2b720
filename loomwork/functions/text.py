"""String expressions over concept paths, labels and report text (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_WORDS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A")


def clean(c) -> Column:
    """Runs of white space (Unicode) to one blank, trimmed; null to ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def trimmed(c) -> Column:
    """White space (Unicode) cut from both ends; null to ''."""
    return F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def or_null(c) -> Column:
    """Words that stand for a missing cell, as null."""
    return F.when(F.trim(c).isin(*NULL_WORDS), None).otherwise(c)


def field(c) -> Column:
    """A path without one leading `structured.`"""
    return F.regexp_replace(trimmed(c), r"^structured\.", "")


def listed(c) -> Column:
    """A comma list as an array: trimmed, no empties, first occurrences."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def merged(a, b) -> Column:
    """Two arrays as one, first occurrences in order."""
    return F.array_distinct(F.concat(a, b))


def prefixed(path, text, on: bool = True) -> Column:
    return F.concat(path, F.lit(": "), text) if on else F.col(text) if isinstance(text, str) else text


def safe_name(c) -> Column:
    """Blanks, slashes, colons and dots as underscores."""
    return F.translate(c, " /\\:.", "_____")


def image_id(path) -> Column:
    """patient/study/view id with underscores, backslashes taken for slashes; an error for any other path."""
    plain = F.translate(path, "\\", "/")
    found = F.regexp_extract(plain, r"(?i)(patient\d+/study\d+/view\d+_[^/]+)\.(jpg|jpeg|png)$", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no image id in "), path)).cast("string")).otherwise(F.replace(found, F.lit("/"), F.lit("_")))


def view(path, cell) -> Column:
    """frontal or lateral: what the cell says (frontal first), else lateral if the path says so, else frontal."""
    said = F.lower(F.coalesce(cell, F.lit("")))
    return F.when(said.contains("frontal") | ~(said.contains("lateral") | F.lower(F.coalesce(path, F.lit(""))).contains("lateral")), "frontal").otherwise("lateral")


def run_stamp(at) -> Column:
    """A run's name by its time."""
    return F.date_format(at, "yyyyMMdd-HHmmss")


def is_absent(label) -> Column:
    return F.coalesce(F.lower(F.trim(label)) == "not present", F.lit(False))


def label_text(label) -> Column:
    return F.coalesce(F.col(label).cast("string") if isinstance(label, str) else label.cast("string"), F.lit(""))


def under(path, prefixes) -> Column:
    """The path starts with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(path, F.lit(p))
    return out


def excluded(path, names=(), prefixes=()) -> Column:
    """Left out by exact name or by prefix."""
    return path.isin(*names) | under(path, prefixes) if names else under(path, prefixes)


def report_id(file_name) -> Column:
    """The id in `<id>_structured.json`; ids may hold underscores."""
    return F.regexp_extract(file_name, r"([^/]+)_structured\.json$", 1)


def filled(template: str, **columns) -> Column:
    """A template with {name} replaced."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def message_text(parts) -> Column:
    """Texts of a message's parts, a line each."""
    return F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != "")), "\n")
