"""Fields of records: values recovered and split, invalid ones moved or hidden, events; and lists at a path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identifiers import RULES
from .text import to_ascii

#: Where a value of a kind may stand in a text; the second group is the value.
PATTERNS = {
    "ISSN": "(^|[^0-9Xx-])([0-9]{4}-?[0-9]{3}[0-9Xx])(?=$|[^0-9])",
    "ISBN": "(^|[^0-9Xx-])(97[89][- ]?(?:[0-9][- ]?){9}[0-9]|(?:[0-9][- ]?){9}[0-9Xx])(?=$|[^0-9])",
}


def found(value: Column, kind: str) -> Column:
    """All values of a kind in a text, in order."""
    return F.regexp_extract_all(to_ascii(value), F.lit(PATTERNS[kind]), 2)


def split(ids: Column, kind: str) -> Column:
    """The identifiers with each one of a kind whose text holds values replaced by those, as siblings; one without any stays."""
    def one(x: Column) -> Column:
        hits = found(x["value"], kind)
        return F.when((x["@type"] == kind) & (F.size(hits) > 0), F.transform(hits, lambda v: x.withField("value", v))).otherwise(F.array(x))

    return F.flatten(F.transform(F.coalesce(ids, F.array()), one))


def halved(value: Column) -> Column:
    """Of an ISI number that stands twice in 30 letters the number once."""
    half = F.left(value, F.lit(15))
    return F.when((F.length(value) == 30) & (half == F.right(value, F.lit(15))), half).otherwise(value)


def extended(value: Column) -> Column:
    """An ORCID that lost its first zero, whole."""
    return F.when(value.rlike("^000-?000[1-3]"), F.concat(F.lit("0"), value)).otherwise(value)


def valid(x: Column, kinds: list[str]) -> Column:
    """Whether an identifier is valid by its kind's rule; other kinds pass."""
    out = F.lit(True)
    for k in kinds:
        out = F.when(x["@type"] == k, RULES[k].valid(x["value"])).otherwise(out)
    return F.coalesce(out, F.lit(True))


MOVED = ["DOI", "ISBN", "ISI", "ISSN"]


def without_invalid(ids: Column) -> Column:
    return F.filter(F.coalesce(ids, F.array()), lambda x: valid(x, MOVED))


def invalid(ids: Column, already: Column | None = None) -> Column:
    """What stands under incorrectlyIdentifiedBy: what stood there, and the identifiers that are not valid."""
    bad = F.filter(F.coalesce(ids, F.array()), lambda x: ~valid(x, MOVED))
    return bad if already is None else F.concat(F.coalesce(already, F.array()), bad)


def redacted(ids: Column, word: str = "[redacted]") -> Column:
    """The identifiers with the values of invalid ORCIDs hidden, as they may hold other personal data."""
    return F.transform(F.coalesce(ids, F.array()), lambda x: F.when((x["@type"] == "ORCID") & ~RULES["ORCID"].valid(x["value"]), x.withField("value", F.lit(word))).otherwise(x))


def with_events(fields: Column) -> Column:
    """Fields (structs with an array ``events``) that something happened to."""
    return F.filter(fields, lambda f: F.size(F.coalesce(f["events"], F.array())) > 0)


def remote(known: Column, policy: str) -> Column:
    """Validity that only a remote service could tell, offline: by the list of known values, else as the policy says."""
    if policy not in ("known", "assume_valid", "assume_invalid"):
        raise ValueError(f"Invalid policy: {policy}")
    return F.coalesce(known, F.lit(False)) | F.lit(policy == "assume_valid")


def orcids_from_local(people: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (oai_id, cache_key, orcid) with missing ORCIDs from other records' local ids: status enriched, own or pending, and the record it came from."""
    cache = known.groupBy("cache_key").agg(F.min_by(F.struct("orcid", "source_oai_id"), "source_oai_id").alias("__k"))
    df = people.join(cache, "cache_key", "left")
    status = F.when(F.col("orcid").isNotNull(), "own").when(F.col("__k").isNotNull(), "enriched").otherwise("pending")
    return df.select("oai_id", "cache_key", F.coalesce("orcid", "__k.orcid").alias("orcid"), status.alias("status"), F.when(status == "enriched", F.col("__k.source_oai_id")).alias("source_oai_id"))


def read_at(items: Column, at: int) -> Column:
    return F.get(items, F.lit(at))


def update_at(items: Column, at: int, change: Callable[[Column], Column]) -> Column:
    """The list with the element at a place changed."""
    return F.transform(items, lambda x, i: F.when(i == at, change(x)).otherwise(x))


def remove_at(items: Column, *at: int) -> Column:
    """The list without the elements at some places, counted before any is gone."""
    return F.filter(items, lambda x, i: ~i.isin(*at))


def append(items: Column, item: Column) -> Column:
    return F.concat(F.coalesce(items, F.array()), F.array(item))


def sibling(items: Column, at: int, **fields: Column) -> Column:
    """The list with a copy of the element at a place at its end, some fields of it changed."""
    copy = F.get(items, F.lit(at))
    for k, v in fields.items():
        copy = copy.withField(k, v)
    return append(items, copy)
