"""Interval labels, missing tokens and closed vocabularies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
MISSING = ["", "p", "?", "na", "nan", "null", "-"]
STAGES = {"s1": 1.0, "s2": 2.0, "s3": 3.0, "s4": 4.0, "s5": 5.0}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DIPSTICK = {
    "neg": 0.0, "negative": 0.0, "none": 0.0, "tr": 1.0, "trace": 1.0, "1+": 1.0, "2+": 2.0, "3+": 3.0, "4+": 4.0,
    "30": 2.0, "100": 3.0, "300": 4.0, "500": 5.0, ">300": 5.0, ">600": 5.0, "small": 1.0, "moderate": 3.0, "large": 4.0,
    "0-2": 1.0, "3-5": 2.0, "6-10": 3.0, "11-20": 4.0, ">50": 5.0, "21-50": 4.0,
}
CATEGORIES = {"normal": 0.0, "abnormal": 1.0, "notpresent": 0.0, "present": 1.0, "no": 0.0, "yes": 1.0, "good": 0.0, "poor": 1.0}

NUMBER = r"[+-]?\d+(?:\.\d+)?"
RANGE = rf"^({NUMBER})\s*[-–—]\s*({NUMBER})$"
INFINITY = float("inf")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalise_label(c: Column) -> Column:
    """No-break space to space, one spelling of comparisons, white space collapsed and trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, "[≥⩾]", ">="), "[≤⩽]", "<=")
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(normalise_label(c)).isin(MISSING)


def number(c: Column) -> Column:
    """Double of a text, null if it is none; surrounding white space does not count."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "").try_cast("double")


def _bound(c: Column, use) -> Column:
    """use(c), with c evaluated once: inlined it would be repeated in every branch."""
    return F.transform(F.array(c), use)[0]


def _interval(text: Column, swap: bool) -> Column:
    lo, hi = F.regexp_extract(text, RANGE, 1).try_cast("double"), F.regexp_extract(text, RANGE, 2).try_cast("double")
    first, last = (F.least(lo, hi), F.greatest(lo, hi)) if swap else (lo, hi)
    inf = F.lit(INFINITY)
    mark = F.regexp_extract(text, r"^([<>]=?)", 1)
    rest = number(F.regexp_replace(text, r"^[<>]=?", ""))
    plain = F.when(text.rlike(rf"^{NUMBER}$"), text.try_cast("double"))
    make = lambda a, b, r: F.struct(a.alias("lower"), b.alias("upper"), r.alias("rep"))
    return (
        F.when(text.rlike(RANGE), make(first, last, (first + last) / F.lit(2.0)))
        .when(mark.startswith(">") & rest.isNotNull(), make(rest, inf, rest))
        .when(mark.startswith("<") & rest.isNotNull(), make(-inf, rest, rest))
        .when(plain.isNotNull(), make(plain, plain, plain))
    )


def parse_bin(label: Column) -> Column:
    """STRUCT<lower, upper, rep> of an interval label; null if it is none. Reversed edges are swapped."""
    return _bound(normalise_label(label), lambda text: _interval(text, swap=True))


def undo_excel_date(label: Column) -> Column:
    """`D-Mon` back to `M - D`; other labels and unknown months stay."""
    pattern = r"^\s*(\d+)\s*-\s*([A-Za-z]{3})\s*$"
    month = F.element_at(literal_map({m: i for i, m in enumerate(MONTHS, 1)}), F.lower(F.regexp_extract(label, pattern, 2)))
    day = F.regexp_extract(label, pattern, 1).try_cast("int")
    return F.when(label.rlike(pattern) & month.isNotNull(), F.concat(month.cast("string"), F.lit(" - "), day.cast("string"))).otherwise(label)


def parse_interval(label: Column) -> Column:
    """Like parse_bin, after undoing spreadsheet dates and without swapping reversed edges; missing gives null."""
    text = undo_excel_date(F.trim(label))
    return _bound(normalise_label(text), lambda t: F.when(~F.lower(t).isin("", "nan", "?"), _interval(t, swap=False)))


def lookup(values: dict, c: Column) -> Column:
    """The value of a lower-case, trimmed token; null if unknown."""
    return F.element_at(literal_map(values), F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")))


def normalise_category(c: Column) -> Column:
    return F.coalesce(lookup(CATEGORIES, c), number(c))


def stage_ordinal(c: Column) -> Column:
    return F.element_at(literal_map(STAGES), c)


def strip_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
