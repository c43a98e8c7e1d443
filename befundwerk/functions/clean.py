"""Scalar cleaning as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, for Java and RE2 regular expressions alike (a character class body).
SPACE = r"\t-\r \x1c-\x1f\x85\xa0"
SPACE_JAVA = SPACE + r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RE2 = SPACE.replace(r"\x85\xa0", r"\x{85}\x{a0}") + r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same as characters, for kernels that take a set.
SPACE_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Cut white space of any kind at both ends; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, f"^[{SPACE_JAVA}]+|[{SPACE_JAVA}]+$", "")


def clean_label(c: Column | str) -> Column:
    """Stripped text, empty for null and for nan, none and null in any case."""
    s = F.coalesce(strip(c), F.lit(""))
    return F.when(F.lower(s).isin("nan", "none", "null"), "").otherwise(s)


def clean_id(c: Column | str) -> Column:
    """As clean_label, and a final .0 after digits only is dropped."""
    return F.regexp_replace(clean_label(c), r"^(-?[0-9]+)\.0$", "$1")


def number(c: Column | str) -> Column:
    """The double that a cell spells, null if it spells none; Java's type suffixes are no numbers here."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))


def flag(c: Column) -> Column:
    """1 where ``c`` holds, else 0."""
    return F.when(c, 1).otherwise(0).cast("int")


def truthy(c: Column | str) -> Column:
    """Whether a cell reads 1, true or yes."""
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes"), F.lit(False))


#: Date spellings that are tried in this order.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy", "dd.MM.yy", "yyyy/MM/dd")


def parse_date(c: Column | str) -> Column:
    """The first of DATE_FORMATS that fits as a timestamp; null for impossible dates."""
    s = strip(c)
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS)).cast("timestamp_ntz")
