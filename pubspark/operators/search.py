"""Search over the marts: optional filters, then semi-joins on the one-to-many marts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import year_range

CONTENT = ("ref", "vet", "pop")
STATUS = ("published", "epub", "submitted", "retracted")


@dataclass
class SearchQuery:
    years: tuple[int, int] | None = None
    flags: dict[str, bool] = field(default_factory=dict)  # swedish_list, open_access, autoclassified, doaj
    content_marking: list[str] = field(default_factory=list)
    publication_status: list[str] = field(default_factory=list)
    creator: dict[str, str] = field(default_factory=dict)  # equalities on one creator row
    orgs: list[str] = field(default_factory=list)
    subjects: list[str] = field(default_factory=list)
    genres: list[str] = field(default_factory=list)  # equal
    genre_prefixes: list[str] = field(default_factory=list)  # broader
    title: str = ""
    keywords: str = ""


def genre_condition(value: Column, equal: list[str], prefixes: list[str]) -> Column:
    """Equal to one, or like one with anything after it; case of A-Z plays no part, dots count as slashes, and % and _ stay wildcards."""
    tests = [value.isin(equal)] if equal else []
    tests += [value.ilike(p.replace(".", "/").rstrip("/") + "%") for p in prefixes]
    return reduce(lambda a, b: a | b, tests)


def fold(c: Column) -> Column:
    """Lower case without accents (of the Latin letters)."""
    plain = {"àáâãäåā": "a", "çćč": "c", "èéêëē": "e", "ìíîïī": "i", "ñń": "n", "òóôõöō": "o", "ùúûüū": "u", "ýÿ": "y", "šś": "s", "žź": "z"}
    return F.translate(F.lower(c), "".join(plain), "".join(v * len(k) for k, v in plain.items()))


def words(c: Column) -> Column:
    return F.filter(F.split(fold(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def match(df: DataFrame, column: str, phrase: str) -> DataFrame:
    """Rows whose column has every word of the phrase (all words are bound to the column)."""
    need = words(F.lit(phrase))
    return df.where(F.size(F.array_except(need, words(F.col(column)))) == 0)


def search_ids(single: DataFrame, q: SearchQuery, creator: DataFrame, org: DataFrame, subject: DataFrame, genre: DataFrame, fulltext: DataFrame | None = None) -> DataFrame:
    """The rows of ``search_single`` that meet every given condition."""
    for given, allowed in ((q.content_marking, CONTENT), (q.publication_status, STATUS)):
        if bad := [x for x in given if x not in allowed]:
            raise ValueError(f"Invalid value: {bad[0]}")
    df = year_range(single, *(q.years or (None, None)))
    for name, value in q.flags.items():
        df = df.where(F.col(name) == int(value))
    for name, given in (("content_marking", q.content_marking), ("publication_status", q.publication_status)):
        if given:
            df = df.where(F.col(name).isin(given))
    if q.creator:
        df = df.join(reduce(lambda c, kv: c.where(F.col(kv[0]) == kv[1]), q.creator.items(), creator), "finalized_id", "left_semi")
    for mart, given in ((org, q.orgs), (subject, q.subjects)):
        if given:
            df = df.join(mart.where(F.col("value").isin(given)), "finalized_id", "left_semi")
    if q.genres or q.genre_prefixes:
        df = df.join(genre.where(genre_condition(F.col("value"), q.genres, q.genre_prefixes)), "finalized_id", "left_semi")
    for column, phrase in (("title", q.title), ("keywords", q.keywords)):
        if phrase:
            df = df.join(match(fulltext, column, phrase), "finalized_id", "left_semi")
    return df


def with_doi(found: DataFrame, doi: DataFrame, value: str) -> DataFrame:
    """Those of the found records that have a DOI."""
    return found.join(doi.where(F.col("value") == value), "finalized_id", "left_semi")


def matching_orgs(found: DataFrame, org: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Organisations of the found records, by name; where some were asked for, only those."""
    rows = org.where(F.col("value").isin(only)) if only else org
    return rows.join(found.select("finalized_id"), "finalized_id", "left_semi").select("value").distinct().orderBy("value")


def page(df: DataFrame, order: list[str | Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of the rows in order."""
    if offset is not None and limit is None:
        raise ValueError("Parameter 'offset' must be used together with 'limit'")
    if (limit or 0) < 0 or (offset or 0) < 0:
        raise ValueError("Parameters 'limit' and 'offset' must be non-negative")
    df = df.orderBy(*order)
    if limit is None:
        return df
    return df.limit(limit + (offset or 0)).offset(offset or 0)


def flag_condition(fields: list[tuple[str, str, int]], audits: list[tuple[str, int]]) -> Column | None:
    """Any of (field, status column, status) and (audit code, result); none gives no filter."""
    tests = [(F.col("field_name") == f) & (F.col(c) == v) for f, c, v in fields] + [(F.col("audit_code") == a) & (F.col("audit_result") == r) for a, r in audits]
    return reduce(lambda a, b: a | b, tests) if tests else None
