"""Text and name functions as column expressions: folding, keys, numerals, name parts, dates and titles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Publication statuses, the one that goes before all others first.
STATUSES = ["Published", "EpubAheadOfPrint/OnlineFirst", "InPrint", "Accepted", "Submitted", "Preprint", "Retracted"]
#: Latin letters with marks, and the plain letters that they decompose to.
FOLD = {chr(c): d[0] for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c)))[0].isascii() and len(d) > 1}


def fold(c: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(c, "".join(FOLD), "".join(FOLD.values()))


def status_rank(c: Column) -> Column:
    """1 for the status that goes first; unknown ones come after all."""
    ranks = F.create_map(*(F.lit(x) for k, s in enumerate(STATUSES, 1) for x in (s, k)))
    return F.coalesce(F.try_element_at(ranks, c), F.lit(len(STATUSES) + 1))


def to_ascii(c: Column) -> Column:
    """Fraction slash and en dash become their plain forms; all else beyond ASCII goes."""
    return F.regexp_replace(F.translate(c, "⁄–", "/-"), "[^\\x00-\\x7F]", "")


def local_id_key(source: Column, code: Column, value: Column, name: Column) -> Column:
    """The key under which a person's local id is kept: source, code, value and the name's first 32 letters without case and accents."""
    return F.concat_ws("_", source, code, value, F.substring(F.lower(fold(name)), 1, 32))


def is_numeral(c: Column) -> Column:
    """Roman or Arabic."""
    return c.rlike("^[IVXLCDM0-9]+$")


def same_name_part(a: Column, b: Column) -> Column:
    """An initial fits any name that it begins; others may differ by more letters the longer the shorter one is."""
    short = F.least(F.length(a), F.length(b))
    slack = F.when(short > 14, 4).when(short > 7, 3).when(short > 4, 2).when(short > 2, 1).otherwise(0)
    return F.when(short == 1, F.substring(a, 1, 1) == F.substring(b, 1, 1)).otherwise((short > 1) & (F.levenshtein(a, b) <= slack))


def same_date(a: Column, b: Column) -> Column:
    """Equal as far as the shorter date goes."""
    n = F.least(F.length(a), F.length(b))
    return F.left(a, n) == F.left(b, n)


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """As much of YYYY-MM-DD as is given."""
    month = F.when(year.isNotNull(), month)
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.when(month.isNotNull(), F.lpad(day.cast("string"), 2, "0")))


def bare_eid(c: Column) -> Column:
    return F.regexp_replace(c, "^2-s2\\.0-", "")


def main_title(title: Column, subtitle: Column) -> Column:
    """Up to the first colon, unless there is a subtitle already."""
    return F.when(F.coalesce(subtitle, F.lit("")) != "", title).otherwise(F.split(title, ":", 2)[0])


def sub_title(title: Column, subtitle: Column) -> Column:
    """The subtitle, else what follows the title's first colon; null for neither."""
    return F.when(F.coalesce(subtitle, F.lit("")) != "", subtitle).otherwise(F.trim(F.get(F.split(title, ":", 2), F.lit(1))))
