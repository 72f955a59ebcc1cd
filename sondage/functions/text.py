"""Text screening as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_html(c: Column) -> Column:
    """Script and style blocks and tags become spaces, white space collapses."""
    c = F.regexp_replace(c, r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " ")


def sentence_around(text: Column, position: Column, width: int) -> Column:
    """The trimmed window of width characters round a 1-based position."""
    low = F.greatest(F.lit(0), position - 1 - width // 2)
    high = F.least(F.length(text), position - 1 + width // 2)
    return F.trim(text.substr(low + 1, high - low))


def any_of(text: Column, cues: list[str]) -> Column:
    found = F.lit(False)
    for cue in cues:
        found = found | text.contains(cue)
    return found


def largest_percent(text: Column) -> Column:
    """The largest figure from 50 to 100 before a percent sign; null without one."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{2}\.?\d*)\s*%"), 1), lambda x: x.cast("double"))
    return F.array_max(F.filter(hits, lambda x: (x >= 50.0) & (x <= 100.0)))


def latex_escape(c: Column) -> Column:
    for plain, escaped in (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("_", "\\_"), ("#", "\\#"), ("$", "\\$")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def shown(c: Column, digits: int = 3) -> Column:
    """A number with fixed digits; n/a if it is not finite."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, F.format_string(f"%.{digits}f", F.round(c, digits))).otherwise("n/a")
