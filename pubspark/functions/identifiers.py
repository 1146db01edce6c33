"""Validation, recovery and normalisation of identifiers, as column expressions.

``clean`` runs a field's rule: validate; recover what failed; validate again;
normalise what is valid. Statuses: validation 0 invalid, 1 valid; enrichment 0
unchanged, 1 enriched, 2 unsuccessful; normalization 0 unchanged, 1 normalised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expr = Callable[[Column], Column]


def _digits(c: Column, n: int) -> list[Column]:
    """The first n characters as numbers, X as 10, others null."""
    at = [F.substring(c, k + 1, 1) for k in range(n)]
    return [F.when(x == "X", 10).otherwise(x.try_cast("int")) for x in at]


def _compact(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[- ]", ""))


def issn_valid(c: Column) -> Column:
    d = _digits(_compact(c), 8)
    total = sum((d[k] * (8 - k) for k in range(8)), F.lit(0))
    return F.coalesce(c.rlike("^[0-9]{4}-?[0-9]{3}[0-9Xx]$") & (total % 11 == 0), F.lit(False))


def isbn_valid(c: Column) -> Column:
    x = _compact(c)
    d = _digits(x, 13)
    ten = x.rlike("^[0-9]{9}[0-9X]$") & (sum((d[k] * (10 - k) for k in range(10)), F.lit(0)) % 11 == 0)
    thirteen = x.rlike("^[0-9]{13}$") & (sum((d[k] * (3 if k % 2 else 1) for k in range(13)), F.lit(0)) % 10 == 0)
    form = c.rlike("^[0-9]([0-9]|[- ](?=[0-9Xx])){8,15}[0-9Xx]$")
    return F.coalesce(form & (ten | thirteen), F.lit(False))


def orcid_digits(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(c, "^https?://orcid\\.org/", ""), "-", ""))


def mod_11_2(digits: Column, n: int) -> Column:
    """The check value of the first n digits by ISO 7064 mod 11-2."""
    total = F.lit(0)
    for k in range(n):
        total = (total + F.substring(digits, k + 1, 1).try_cast("int")) * 2 % 11
    return (12 - total) % 11


def orcid_valid(c: Column) -> Column:
    d = orcid_digits(c)
    form = c.rlike("^(https?://orcid\\.org/)?[0-9]{4}-?[0-9]{4}-?[0-9]{4}-?[0-9]{3}[0-9Xx]$")
    number = F.substring(d, 1, 15).try_cast("long")
    spans = number.between(15000000, 35000001) | number.between(900000000000, 900100000000)
    check = F.when(F.substring(d, 16, 1) == "X", 10).otherwise(F.substring(d, 16, 1).try_cast("int"))
    return F.coalesce(form & spans & (mod_11_2(d, 15) == check), F.lit(False))


def doi_bare(c: Column) -> Column:
    return F.regexp_replace(c, "^https?://(dx\\.)?doi\\.org/", "")


def doi_valid(c: Column) -> Column:
    return F.coalesce(~c.rlike("[\\p{Cc}\\p{Cf}\\p{Z}]") & doi_bare(c).rlike("^10\\.[^/]+/.+$"), F.lit(False))


def isi_valid(c: Column) -> Column:
    return F.coalesce(c.rlike("^(00[01][0-9]{12}|[Aa]19[0-9a-zA-Z]{12})$"), F.lit(False))


def uri_valid(c: Column) -> Column:
    return F.coalesce(c.rlike("^[\\x00-\\x7F]*$"), F.lit(False))


def year_valid(c: Column) -> Column:
    """A year, or a year, month and day of the calendar."""
    return F.coalesce(c.rlike("^[0-9]{4}$") | (c.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & c.try_cast("date").isNotNull()), F.lit(False))


def creator_count_valid(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$") & (c.try_cast("long") > 0), F.lit(False))


def ssif_valid(c: Column) -> Column:
    """One, three or five digits; 21101 is a legacy code."""
    return F.coalesce(c.rlike("^([0-9]|[0-9]{3}|[0-9]{5})$") & (c != "21101"), F.lit(False))


def _found(c: Column, pattern: str, group: int) -> Column:
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def issn_recover(c: Column) -> Column:
    return _found(c, "(^|[^0-9Xx-])([0-9]{4}-?[0-9]{3}[0-9Xx])($|[^0-9])", 2)


def isbn_recover(c: Column) -> Column:
    return _found(c, "(^|[^0-9Xx-])(97[89][- ]?([0-9][- ]?){9}[0-9]|([0-9][- ]?){9}[0-9Xx])($|[^0-9])", 2)


def orcid_recover(c: Column) -> Column:
    return _found(c, "([0-9]{4}-?[0-9]{4}-?[0-9]{4}-?[0-9]{3}[0-9Xx])", 1)


def doi_recover(c: Column) -> Column:
    """Illegal characters dropped, cut at the first "10."."""
    return _found(F.regexp_replace(F.translate(c, "⁄", "/"), "[\\p{Cc}\\p{Cf}\\p{Z}]", ""), "(10\\..*)", 1)


def isi_recover(c: Column) -> Column:
    return _found(c, "(00[01][0-9]{12}|[Aa]19[0-9a-zA-Z]{12})", 1)


def issn_normal(c: Column) -> Column:
    x = _compact(c)
    return F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(x, 5, 4))


def isbn_normal(c: Column) -> Column:
    return _compact(c)


def orcid_normal(c: Column) -> Column:
    d = orcid_digits(c)
    return F.concat(F.lit("https://orcid.org/"), F.concat_ws("-", *(F.substring(d, k, 4) for k in (1, 5, 9, 13))))


def doi_normal(c: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi_bare(c))


def doab_ids(isbns: Column, dois: Column) -> Column:
    """Identifiers of a book row: ISBNs of over nine characters without hyphens, DOIs from "10." on with a slash and over five characters."""
    books = F.filter(F.transform(F.split(isbns, ";|\\|\\|"), lambda x: F.regexp_replace(F.trim(x), "-", "")), lambda x: F.length(x) > 9)
    found = F.transform(F.split(dois, "\\|\\|"), lambda x: F.regexp_extract(x, "10\\..*", 0))
    return F.concat(books, F.filter(found, lambda x: x.contains("/") & (F.length(x) > 5)))


@dataclass
class Rule:
    valid: Expr
    recover: Expr | None = None
    normal: Expr | None = None


RULES = {
    "ISSN": Rule(issn_valid, issn_recover, issn_normal), "ISBN": Rule(isbn_valid, isbn_recover, isbn_normal), "ORCID": Rule(orcid_valid, orcid_recover, orcid_normal),
    "DOI": Rule(doi_valid, doi_recover, doi_normal), "ISI": Rule(isi_valid, isi_recover, F.upper), "URI": Rule(uri_valid), "publication_year": Rule(year_valid),
    "creator_count": Rule(creator_count_valid), "SSIF": Rule(ssif_valid),
}


def clean(df: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Add new_value and the three statuses of a field's rule; no shuffle, no Python."""
    r, v = RULES[kind], F.col(column)
    df = df.withColumn("__one", r.valid(v))
    found = F.when(~F.col("__one"), r.recover(v)) if r.recover else F.lit(None).cast("string")
    df = df.withColumn("__found", found).withColumn("__used", F.coalesce("__found", column))
    df = df.withColumn("__two", F.col("__one") | F.coalesce(r.valid(F.col("__used")), F.lit(False)))
    new = F.when(F.col("__two"), r.normal(F.col("__used"))).otherwise(F.col("__used")) if r.normal else F.col("__used")
    df = df.withColumn("new_value", new)
    enriched = F.when(F.col("__one"), 0).when(F.col("__two"), 1).otherwise(2 if r.recover else 0)
    return df.select(*(c for c in df.columns if not c.startswith("__")), F.col("__two").cast("int").alias("validation"), enriched.alias("enrichment"), (F.col("__two") & (F.col("new_value") != F.col("__used"))).cast("int").alias("normalization"))
