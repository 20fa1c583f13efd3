"""Column expressions for messy cells: blanks, numbers, dates, keys. All of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a number may carry besides its digits.
MONEY = r"[,\s$€£¥₹]"
#: Text that counts as a number. Stricter than a cast, which also takes 1d, 0x1p3 and Infinity.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Date formats in the order they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "d/M/yyyy", "MMM d, yyyy", "MMM d yyyy", "dd-MM-yyyy")
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss")
GEO = r"^\s*(-?[0-9]{1,3}\.[0-9]+)\s*[, ]\s*(-?[0-9]{1,3}\.[0-9]+)\s*$"
_ENDS = r"(?U)^\s+|\s+$"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f uses it (inside other functions' lambdas, too)."""
    return F.element_at(F.transform(F.array(x), f), 1)


def trimmed(c: Column) -> Column:
    """Without white space at either end, not only spaces."""
    return F.regexp_replace(c, _ENDS, "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; never null itself."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def blank_to_null(c: Column) -> Column:
    """The cell as it is, or null where it is blank."""
    return F.when(~is_blank(c), c)


def plain_number(c: Column) -> Column:
    """A double from text that is a number as it stands."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def number(c: Column) -> Column:
    """A double from text once currency signs, separators and white space are gone; null if it is none."""
    return plain_number(F.regexp_replace(c, MONEY, ""))


def integer(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int"))


def shown_number(x: Column) -> Column:
    """A double as text; whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def half_up(x: Column, digits: int | Column = 0) -> Column:
    """Rounded with halves going up, for negative numbers too."""
    scale = F.pow(F.lit(10.0), F.lit(digits) if isinstance(digits, int) else digits)
    return F.floor(x * scale + 0.5) / scale


def round3(x: Column) -> Column:
    return half_up(x, 3)


def iso_date(c: Column) -> Column:
    """ISO date of a cell in one of the known formats, time parts dropped; otherwise the text that is left."""
    s = F.substring_index(F.regexp_replace(trimmed(c), "Z$", ""), "T", 1)
    tried = [F.date_format(F.try_to_timestamp(s, F.lit(f)), "yyyy-MM-dd") for f in DATE_FORMATS]
    return F.coalesce(*tried, s)


def is_date(c: Column) -> Column:
    """Whether the whole cell is a date or a date with time; bare numbers and short texts are not."""
    s = trimmed(c)
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in (*DATE_FORMATS, *TIME_FORMATS)])
    return (F.length(s) >= 6) & ~s.rlike(NUMBER) & parsed.isNotNull()


def boolean(c: Column) -> Column:
    """True for true or yes in any case, false for anything else; null stays null."""
    return F.when(c.isNotNull(), F.lower(c).isin("true", "yes"))


def cleaned(c: Column, kind: str) -> Column:
    """The typed value of a cell of a kind."""
    own = blank_to_null(c)
    if kind == "numeric":
        return number(own)
    if kind == "boolean":
        return boolean(own)
    return iso_date(own) if kind == "date" else own


def key_of(c: Column, canonical: str) -> Column:
    """The normalised merge key of a text: e-mails without spaces, phones as digits, others as words; "" is no key."""
    low = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    if canonical == "email":
        return F.replace(low, F.lit(" "), F.lit(""))
    if canonical == "phone":
        return F.regexp_replace(low, r"[^0-9]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9 ]", ""), r"\s+", " "))


def split_values(c: Column) -> Column:
    """The distinct values of a multi-valued cell, in order."""
    parts = F.transform(F.split(c, r"\s*[;|,\n/]\s*"), trimmed)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def as_text(c: Column, is_array: bool = False) -> Column:
    """Flattened text: null is empty, lists are joined by a space."""
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") if is_array else F.coalesce(c.cast("string"), F.lit(""))


def words_of_text(c: Column) -> Column:
    """Lower case with everything but a-z and 0-9 as single spaces, as keyword search reads text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))
