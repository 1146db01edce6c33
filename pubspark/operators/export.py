"""Exports: clusters with their master, change feeds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents, text
from . import relational


def clusters(rows: DataFrame) -> DataFrame:
    """A row for each cluster: its master (least id), publications in order, their number and the latest year."""
    return rows.groupBy("cluster_id").agg(F.min("id").alias("master"), F.sort_array(F.collect_list("id")).alias("publications"), F.count(F.lit(1)).alias("publication_count"), F.max("yr").alias("yr"))


def changed_since(rows: DataFrame, since: int) -> DataFrame:
    """Rows modified after a point, tombstones among them; -1 takes all."""
    return rows if since == -1 else rows.where(F.col("modified") > since)


def split(rows: DataFrame, tenth: Column) -> DataFrame:
    """80 % train, 10 % validation, 10 % test by a number from 0 to 9."""
    return rows.withColumn("part", tenth).withColumn("split", F.when(F.col("part") < 8, "train").when(F.col("part") == 8, "val").otherwise("test"))


def export_fields(d: Column, today: Column) -> dict[str, Column]:
    """Fields that a search may return, by name. Take few: the record's other parts are then not read."""
    t = documents.first_title(d["instanceOf"]["hasTitle"])
    return {
        "recordId": d["@id"], "title": text.main_title(t["mainTitle"], t["subtitle"]), "subtitle": text.sub_title(t["mainTitle"], t["subtitle"]), "publicationYear": documents.publication_year(d),
        "outputTypes": documents.output_types(d), "publicationStatus": documents.publication_status(d), "contentMarking": documents.content_marking(d), "creatorCount": documents.creator_count(d),
        "openAccess": documents.open_access(d, today), "openAccessVersion": documents.open_access_version(d), "DOAJ": documents.in_doaj(d), "electronicLocator": documents.electronic_locator(d),
        "archiveURI": documents.archive_uri(d), "publisher": documents.publisher(d), "summary": documents.summary(d), "languages": documents.languages(d), "publicationChannel": documents.publication_channel(d),
        "subjects": documents.subjects(d), "autoclassified": documents.autoclassified(d), "keywords": documents.keywords(d), "DOI": documents.identifiers(d, "DOI"), "ISI": documents.identifiers(d, "ISI"),
        "PMID": documents.identifiers(d, "PMID"), "scopusId": documents.identifiers(d, "ScopusID"), "ISSN": documents.identifiers(d, "ISSN"), "ISBN": documents.identifiers(d, "ISBN"),
        "series": documents.series(d), "swedishList": documents.level(d) == 1, "publicationCount": documents.publication_count(d), "duplicateIds": d["_publication_ids"], "sourceOrgs": d["_publication_orgs"],
        "creators": documents.creators(d),
    }


def project(rows: DataFrame, names: list[str], today: Column, column: str = "d") -> DataFrame:
    """The named fields of each record; an unknown name is an error before anything runs."""
    known = export_fields(F.col(column), today)
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"Invalid field name: {bad[0]}")
    return rows.select(*(known[n].alias(n) for n in names))


def flat(rows: DataFrame, mark: str = ",") -> DataFrame:
    """Lists of text as one text each, creators as "family, given" with semicolons: fit for CSV (mark ",") and TSV (mark tab)."""
    def one(name: str, kind: str) -> Column:
        if kind.startswith("array<struct"):
            who = F.transform(F.col(name), lambda c: F.concat_ws(", ", c["family_name"], c["given_name"]))
            return F.array_join(who, ";").alias(name)
        return F.array_join(F.col(name), mark).alias(name) if kind.startswith("array") else F.col(name)

    return rows.select(*(one(n, k) for n, k in rows.dtypes))


def write_text(rows: DataFrame, path: str, form: str = "json") -> None:
    """One file for each partition: JSON lines, CSV or TSV with a header."""
    if form not in ("json", "csv", "tsv"):
        raise ValueError(f"Invalid format: {form}")
    if form == "json":
        rows.write.json(path)
    else:
        flat(rows, "," if form == "csv" else "\t").write.csv(path, header=True, sep="," if form == "csv" else "\t", escape='"')


def parse_flags(flags: str, fields: list[str], kinds: dict[str, list[str]]) -> dict[str, list[str]]:
    """Flags such as ``ISBN_valid,DOI_enriched``: the last part is the value, what is before it the field or check."""
    out: dict[str, list[str]] = {}
    for flag in filter(None, (x.strip() for x in flags.split(","))):
        name, _, value = flag.rpartition("_")
        if name not in fields or not any(value in v for v in kinds.values()):
            raise ValueError(f"Invalid flag: '{flag}'")
        out.setdefault(name, []).append(value)
    return out


def flag_rows(info: DataFrame, wanted: dict[str, list[str]], labels: dict[str, dict[int, str]]) -> DataFrame:
    """A row for each record, field and status: (id, field_name, kind, status). Without any flag wanted, all rows."""
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.try_element_at(F.create_map(*(F.lit(x) for p in v.items() for x in p)), F.col(f"{k}_status")).alias("status")) for k, v in labels.items()))
    rows = info.select("id", "field_name", F.explode(F.filter(every, lambda x: x["status"].isNotNull())).alias("s")).select("id", "field_name", "s.kind", "s.status")
    if not wanted:
        return rows
    pairs = [F.concat_ws("_", "field_name", "status") == f"{n}_{v}" for n, vs in wanted.items() for v in vs]
    cond = pairs[0]
    for p in pairs[1:]:
        cond = cond | p
    return rows.where(cond)


def store(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch of records (oai_id, deleted, seq, data): new ones replace old ones, deleted ones leave a tombstone.

    Within a batch the first row of an id stands.
    """
    new = relational.first_wins(batch, "oai_id", ["seq"]).select("oai_id", F.when(~F.col("deleted"), F.col("data")).alias("data"), F.col("deleted").cast("int").alias("deleted"))
    return relational.upsert(old.select("oai_id", "data", "deleted"), new, "oai_id")
