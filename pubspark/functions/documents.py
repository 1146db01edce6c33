"""Accessors of publication documents: column expressions over one nested record, without a shuffle or Python.

``parse`` turns the JSON text of a record into a struct by ``SCHEMA``; every
other function takes that struct. Terms are told by the end of their address,
so no vocabulary's own address is held here. What a record lacks is null, or an
empty array where a list is asked for. "Today" is a parameter, never the clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_T, _I = "`@type`:string", "`@id`:string"
_NOTE = f"array<struct<{_T},{_I},label:string>>"
_TITLE = f"array<struct<{_T},mainTitle:string,subtitle:string,volumeNumber:string,issueNumber:string>>"
_IDS = f"array<struct<{_T},value:string,qualifier:string,source:struct<{_T},code:string>>>"
_POLICY = f"array<struct<{_T},{_I},label:string,endDate:string>>"
_TERM = f"array<struct<{_I}>>"
_LANG = f"struct<{_T},{_I},code:string>"
_AFFIL = f"struct<{_T},{_I},name:string,identifiedBy:{_IDS}>"
_PART = f"struct<{_T},{_I},name:string,identifiedBy:{_IDS},hasAffiliation:array<{_AFFIL}>>"
_AGENT = f"struct<{_T},familyName:string,givenName:string,name:string,identifiedBy:{_IDS}>"
_BROADER = "struct<prefLabel:string,broader:struct<prefLabel:string,broader:struct<prefLabel:string>>>"
_SERIES = f"array<struct<hasTitle:{_TITLE},identifiedBy:{_IDS}>>"
_CLASS = f"array<struct<{_I},{_T},code:string,prefLabel:string,prefLabelByLang:map<string,string>,inScheme:struct<{_I},code:string>,`@annotation`:struct<assigner:struct<{_I}>>>>"
SCHEMA = (
    f"struct<{_I},{_T},instanceOf:struct<{_T},genreForm:{_TERM},language:array<{_LANG}>,hasTitle:{_TITLE},summary:array<struct<{_T},label:string,language:{_LANG}>>,"
    f"contribution:array<struct<{_T},agent:{_AGENT},role:{_TERM},hasAffiliation:array<{_PART}>>>,"
    f"subject:array<struct<{_T},{_I},code:string,prefLabel:string,prefLabelByLang:map<string,string>,broader:{_BROADER},language:{_LANG},inScheme:struct<{_I},code:string>>>,"
    f"classification:{_CLASS},hasNote:{_NOTE},status:{_TERM}>,identifiedBy:{_IDS},incorrectlyIdentifiedBy:{_IDS},indirectlyIdentifiedBy:{_IDS},"
    f"isPartOf:array<struct<{_T},genreForm:{_TERM},hasTitle:{_TITLE},identifiedBy:{_IDS},hasSeries:{_SERIES}>>,hasSeries:{_SERIES},"
    f"meta:struct<assigner:struct<label:string>,creationDate:string,changeDate:string>,publication:array<struct<{_T},agent:struct<{_T},label:string>,date:string>>,"
    f"electronicLocator:array<struct<{_T},uri:string,label:string,hasNote:{_NOTE},usageAndAccessPolicy:{_POLICY}>>,usageAndAccessPolicy:{_POLICY},"
    "_publication_ids:array<string>,_publication_orgs:array<string>>"
)

# Ends of output types by the roles that make a creator, and other terms.
OUTPUT_TYPES_AUT_CRE = [
    "publication/book", "publication/book-chapter", "publication/foreword-afterword", "publication/report-chapter", "publication/encyclopedia-entry", "publication/review-article",
    "publication/doctoral-thesis", "publication/licentiate-thesis", "publication/book-review", "publication/journal-article", "publication/magazine-article", "publication/newspaper-article",
    "publication/editorial-letter", "conference/poster", "conference/paper", "conference/other", "intellectual-property", "intellectual-property/patent", "intellectual-property/other",
    "artistic-work/artistic-thesis", "publication/critical-edition", "publication/working-paper", "publication/preprint", "publication/other", "other", "other/data-set", "other/software",
    "artistic-work/original-creative-work", "artistic-work",
]
OUTPUT_TYPES_EDT = ["publication/edited-book", "conference/proceeding", "publication/journal-issue", "artistic-work", "artistic-work/artistic-thesis", "artistic-work/original-creative-work"]
EDITED = ["EditorialCollection", "EditorialProceedings", "output/publication/edited-book", "output/publication/journal-issue", "output/conference/proceeding"]
REPORTS = ["Report", "output/publication/report"]
ARTICLES = ["JournalArticle", "journal-article", "magazine-article", "newspaper-article", "journal-issue"]
VERSIONS = ["Submitted", "Accepted", "Published"]
SEARCH_STATUS = {"Published": "published", "EpubAheadOfPrint/OnlineFirst": "epub", "Submitted": "submitted", "Retracted": "retracted"}


def parse(json: Column) -> Column:
    return F.from_json(json, SCHEMA)


def _all(c: Column) -> Column:
    """The array, empty for null."""
    return F.coalesce(c, F.array())


def _id(x: Column) -> Column:
    return F.coalesce(x["@id"], F.lit(""))


def _ends(x: Column, ends: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (x.endswith("/" + e) for e in ends))


def _typed(c: Column, kind: str) -> Column:
    return F.filter(_all(c), lambda x: x["@type"] == kind)


def _some(c: Column) -> Column:
    """The text, null if empty."""
    return F.when(F.trim(c) != "", c)


def _values(c: Column, kind: str) -> Column:
    return F.transform(_typed(c, kind), lambda x: x["value"])


def _flat(c: Column, field: str) -> Column:
    """All elements of one array field of an array's elements."""
    return F.flatten(F.transform(_all(c), lambda x: _all(x[field])))


def genres(d: Column) -> Column:
    return F.transform(_all(d["instanceOf"]["genreForm"]), _id)


def first_title(c: Column) -> Column:
    return F.get(_typed(c, "Title"), F.lit(0))


def title(d: Column, mark: str = ": ") -> Column:
    """Main title and subtitle of the first title."""
    t = first_title(d["instanceOf"]["hasTitle"])
    return F.when(_some(t["subtitle"]).isNull(), t["mainTitle"]).otherwise(F.concat_ws(mark, t["mainTitle"], t["subtitle"]))


def publication_date(d: Column) -> Column:
    return F.get(F.filter(F.transform(_typed(d["publication"], "Publication"), lambda x: x["date"]), lambda x: x.isNotNull()), F.lit(0))


def publication_year(d: Column) -> Column:
    """The date's first four digits as a number; other dates give null."""
    return F.substring(publication_date(d), 1, 4).try_cast("int")


def output_types(d: Column) -> Column:
    return F.filter(genres(d), lambda g: g.rlike("/output/[a-z_\\-]+/*[a-z_\\-]*$"))


def content_marking(d: Column) -> Column:
    """The end of the first genre that tells the content: ref, vet or pop."""
    return F.get(F.transform(F.filter(genres(d), lambda g: g.rlike("/(ref|vet|pop)$")), lambda g: F.regexp_extract(g, "/([a-z]+)$", 1)), F.lit(0))


def _notes(d: Column, kind: str) -> Column:
    return _typed(d["instanceOf"]["hasNote"], kind)


def publication_status(d: Column, only: bool = False) -> Column:
    """The first status note's address; with ``only``, null unless there is exactly one."""
    n = _notes(d, "PublicationStatus")
    first = F.get(n, F.lit(0))["@id"]
    return F.when(F.size(n) == 1, first) if only else first


def search_status(d: Column) -> Column:
    s = publication_status(d)
    return F.coalesce(*(F.when(s.endswith("/" + k), v) for k, v in SEARCH_STATUS.items()))


def creator_count(d: Column) -> Column:
    return F.get(_notes(d, "CreatorCount"), F.lit(0))["label"].try_cast("int")


def notes(d: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_notes(d, "Note"), lambda n: n["label"]), lambda x: x.isNotNull()))


def _has_role(c: Column, roles: list[str]) -> Column:
    return F.exists(_all(c["role"]), lambda r: _ends(_id(r), roles))


def creators(d: Column) -> Column:
    """Persons whose role makes them creators of such an output.

    Authors and creators for most output types, editors for edited ones, both for
    artistic work; where no type decides, editors if nobody else is named.
    """
    out = output_types(d)
    of = lambda ends: F.exists(out, lambda g: _ends(g, ["output/" + e for e in ends]))
    persons = F.filter(_all(d["instanceOf"]["contribution"]), lambda c: c["agent"]["@type"] == "Person")
    written, edited = of(OUTPUT_TYPES_AUT_CRE), of(OUTPUT_TYPES_EDT)
    named = F.exists(persons, lambda c: _has_role(c, ["aut", "cre"]))
    authors = written | (~written & ~edited & named)
    editors = edited | (~written & ~edited & ~named)
    kept = F.filter(persons, lambda c: (authors & _has_role(c, ["aut", "cre"])) | (editors & _has_role(c, ["edt"])))

    def person(c: Column) -> Column:
        a = c["agent"]
        local = F.get(_typed(a["identifiedBy"], "Local"), F.lit(0))
        return F.struct(
            a["givenName"].alias("given_name"), a["familyName"].alias("family_name"), local["value"].alias("local_id"), local["source"]["code"].alias("local_id_by"),
            F.get(_values(a["identifiedBy"], "ORCID"), F.lit(0)).alias("orcid"), affiliations(c).alias("affiliations"),
        )

    return F.transform(kept, person)


def affiliations(c: Column) -> Column:
    """Names of a contribution's affiliations and of those within them, outer ones first."""
    top = _all(c["hasAffiliation"])
    names = F.transform(top, lambda a: F.concat(F.array(a["name"]), F.transform(_all(a["hasAffiliation"]), lambda b: b["name"])))
    return F.filter(F.flatten(names), lambda n: _some(n).isNotNull())


def embargoed(d: Column, today: Column) -> Column:
    """The first embargo decides: until the end of its last day, for ever without one, not at all if that is no date."""
    e = F.get(_typed(d["usageAndAccessPolicy"], "Embargo"), F.lit(0))
    end = F.when(e["endDate"].rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), e["endDate"].try_cast("date"))
    return F.coalesce(F.when(e.isNull(), False).when(e["endDate"].isNull(), True).otherwise(end >= today), F.lit(False))


def open_access(d: Column, today: Column) -> Column:
    """Free to read: no embargo, and the first deciding policy, file policy or link note says so."""
    free = lambda p: _id(p).endswith("/oa/gratis")
    shut = lambda p: _id(p).endswith("/oa/restricted")
    label = lambda p: F.when(p["@type"] == "AccessPolicy", F.coalesce(p["label"], F.lit(""))).otherwise("")
    own = F.transform(_all(d["usageAndAccessPolicy"]), lambda p: F.when(free(p) | label(p).contains("gratis"), True).when(label(p).contains("restricted"), False))

    def note(n: Column) -> Column:
        when = F.regexp_extract(n["label"], "/([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
        dated = n["label"].rlike("^free(/[0-9]{4}-[0-9]{2}-[0-9]{2})+$") & (when.try_cast("date") <= today)
        return F.when((n["label"] == "free") | dated, True)

    def link(x: Column) -> Column:
        has = F.coalesce(F.length(x["uri"]) > 0, F.lit(False))
        files = F.transform(_all(x["usageAndAccessPolicy"]), lambda p: F.when(free(p), True).when(shut(p), False))
        return F.when(has & (x["@type"] == "MediaObject"), files).when(has & (x["@type"] == "Resource"), F.transform(_all(x["hasNote"]), note)).otherwise(F.array().cast("array<boolean>"))

    said = F.concat(own, F.flatten(F.transform(_all(d["electronicLocator"]), link)))
    first = F.get(F.filter(said, lambda x: x.isNotNull()), F.lit(0))
    return ~embargoed(d, today) & F.coalesce(first, F.lit(False))


def open_access_version(d: Column) -> Column:
    return F.get(F.filter(F.transform(_flat(d["electronicLocator"], "hasNote"), _id), lambda i: _ends(i, VERSIONS)), F.lit(0))


def in_doaj(d: Column) -> Column:
    return F.exists(_all(d["instanceOf"]["status"]), lambda s: _id(s).endswith("/journal-is-in-doaj"))


def electronic_locator(d: Column) -> Column:
    return F.get(F.filter(F.transform(_typed(d["electronicLocator"], "Resource"), lambda x: x["uri"]), lambda u: F.length(u) > 0), F.lit(0))


def archive_uri(d: Column) -> Column:
    return F.get(_values(d["identifiedBy"], "URI"), F.lit(0))


def publisher(d: Column) -> Column:
    return F.get(F.transform(_typed(d["publication"], "Publication"), lambda p: p["agent"]["label"]), F.lit(0))


def summary(d: Column) -> Column:
    return F.get(F.transform(_all(d["instanceOf"]["summary"]), lambda s: s["label"]), F.lit(0))


def languages(d: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_all(d["instanceOf"]["language"]), lambda x: x["code"]), lambda x: x.isNotNull()))


def publication_channel(d: Column) -> Column:
    """Main title of the first host that is neither a data set nor a project."""
    hosts = F.filter(_all(d["isPartOf"]), lambda p: (F.coalesce(p["@type"], F.lit("")) != "Dataset") & ~F.exists(_all(p["genreForm"]), lambda g: F.lower(_id(g)).contains("project")))
    return F.get(F.filter(F.transform(hosts, lambda p: first_title(p["hasTitle"])["mainTitle"]), lambda t: t.isNotNull()), F.lit(0))


def subject_codes(d: Column) -> Column:
    """Classification codes of one, three or five digits, as given."""
    codes = F.transform(_all(d["instanceOf"]["classification"]), lambda c: F.trim(F.coalesce(c["code"], F.regexp_extract(_id(c), "/([0-9]+)$", 1))))
    return F.array_distinct(F.filter(codes, lambda c: c.rlike("^([0-9]|[0-9]{3}|[0-9]{5})$")))


def subjects(d: Column) -> Column:
    """Classification codes with their ancestors, which are their beginnings."""
    return F.array_distinct(F.flatten(F.transform(subject_codes(d), lambda c: F.array_distinct(F.array(F.left(c, F.lit(1)), F.left(c, F.lit(3)), c)))))


def top_subjects(d: Column) -> Column:
    return F.array_distinct(F.transform(subject_codes(d), lambda c: F.left(c, F.lit(1))))


def is_classified(d: Column) -> Column:
    """Has a code below the first level."""
    return F.exists(subject_codes(d), lambda c: F.length(c) > 1)


def autoclassified(d: Column) -> Column:
    return F.exists(_all(d["instanceOf"]["classification"]), lambda c: F.coalesce(c["@annotation"]["assigner"]["@id"].endswith("/autoclassifier"), F.lit(False)))


def keywords(d: Column) -> Column:
    """Labels of subjects, in all languages, and of what lies above them."""
    def labels(s: Column) -> Column:
        up = s["broader"]
        return F.concat(F.array(s["prefLabel"]), F.coalesce(F.map_values(s["prefLabelByLang"]), F.array().cast("array<string>")), F.array(up["prefLabel"], up["broader"]["prefLabel"], up["broader"]["broader"]["prefLabel"]))

    return F.array_distinct(F.filter(F.flatten(F.transform(_all(d["instanceOf"]["subject"]), labels)), lambda x: _some(x).isNotNull()))


def identifiers(d: Column, kind: str) -> Column:
    """Values of one kind, in this order: of the hosts, their series, the own series, the record itself, indirect ones.

    DOIs and the like stand on the record and its hosts; of these the record's come first.
    """
    own, hosts = _values(d["identifiedBy"], kind), _values(_flat(d["isPartOf"], "identifiedBy"), kind)
    if kind not in ("ISSN", "ISBN"):
        return F.array_distinct(F.concat(own, hosts))
    nested = _values(_flat(_flat(d["isPartOf"], "hasSeries"), "identifiedBy"), kind)
    series = _values(_flat(d["hasSeries"], "identifiedBy"), kind)
    return F.array_distinct(F.concat(hosts, nested, series, own, _values(d["indirectlyIdentifiedBy"], kind)))


def series(d: Column) -> Column:
    """Titles of the record's series and of its hosts' series."""
    every = F.concat(_all(d["hasSeries"]), _flat(d["isPartOf"], "hasSeries"))
    return F.array_distinct(F.filter(F.transform(every, lambda s: first_title(s["hasTitle"])["mainTitle"]), lambda t: t.isNotNull()))


def publication_count(d: Column) -> Column:
    return F.size(_all(d["_publication_ids"]))


def level(d: Column) -> Column:
    """The first list marker in the genres' order: 1 peer-reviewed, 0 not, null for none."""
    at = lambda g: F.when(g.endswith("/swedishlist/peer-reviewed"), 1).when(g.endswith("/swedishlist/non-peer-reviewed"), 0)
    return F.get(F.filter(F.transform(genres(d), at), lambda x: x.isNotNull()), F.lit(0))


def count_creators(d: Column) -> Column:
    """Contributions by authors; by editors for edited works; for reports without authors, editor roles."""
    c = _typed(d["instanceOf"]["contribution"], "Contribution")
    with_role = lambda roles: F.size(F.filter(c, lambda x: _has_role(x, roles)))
    authors = with_role(["aut", "cre"])
    roles = F.size(F.filter(_flat(c, "role"), lambda r: _id(r).endswith("/edt")))
    of = lambda ends: F.exists(genres(d), lambda g: _ends(g, ends))
    return F.when(of(REPORTS), F.when(authors == 0, roles).otherwise(authors)).when(of(EDITED), with_role(["edt"])).otherwise(authors)


def has_duplicate_persons(d: Column) -> Column:
    """Two persons with both names, equal but for case, and the same identifiers and roles: equal keys, found by counting distinct ones."""
    def key(c: Column) -> Column:
        a = c["agent"]
        ids = F.array_sort(F.array_distinct(F.transform(_all(a["identifiedBy"]), lambda i: F.to_json(i))))
        return F.struct(F.lower(F.trim(a["givenName"])).alias("g"), F.lower(F.trim(a["familyName"])).alias("f"), ids.alias("i"), F.array_sort(F.array_distinct(F.transform(_all(c["role"]), _id))).alias("r"))

    named = lambda c: (c["agent"]["@type"] == "Person") & (c["agent"]["givenName"] != "") & (c["agent"]["familyName"] != "")
    keys = F.transform(F.filter(_all(d["instanceOf"]["contribution"]), named), key)
    return F.size(F.array_distinct(keys)) < F.size(keys)


def is_article(d: Column) -> Column:
    return F.exists(genres(d), lambda g: _ends(g, ARTICLES))


def policies(d: Column) -> Column:
    """Access policies in four kinds: open access, embargo, links, other."""
    p = _all(d["usageAndAccessPolicy"])
    embargo = lambda x: F.coalesce(x["@type"] == "Embargo", F.lit(False))
    access = lambda x: ~embargo(x) & F.coalesce((x["@type"] == "AccessPolicy") | _id(x).contains("/oa/"), F.lit(False))
    link = lambda x: ~embargo(x) & ~access(x) & (_id(x) != "")
    return F.struct(F.filter(p, access).alias("access"), F.filter(p, embargo).alias("embargo"), F.filter(p, link).alias("links"), F.filter(p, lambda x: ~(embargo(x) | access(x) | link(x))).alias("other"))


def elements_size(d: Column) -> Column:
    """Elements of the work's lists, and the letters of its type: the measure by which a group's master is picked."""
    w = d["instanceOf"]
    lists = ["genreForm", "language", "hasTitle", "summary", "contribution", "subject", "classification", "hasNote", "status"]
    return reduce(lambda a, b: a + b, (F.size(_all(w[k])) for k in lists)) + F.coalesce(F.length(w["@type"]), F.lit(0))


def audits(d: Column) -> dict[str, Column]:
    """Record checks by name: the fault is there (creator_count_*: all is well); null for a check that does not apply."""
    stated, status = creator_count(d), publication_status(d, only=True)
    none = F.size(_notes(d, "PublicationStatus")) == 0
    return {
        "creator_count_note_exists": stated.isNotNull(),
        "creator_count_check": F.when(stated.isNotNull(), count_creators(d) <= stated),
        "contributor_duplicate_check": has_duplicate_persons(d),
        "SSIF_comprehensive_check": ~is_classified(d),
        "ISSN_missing_check": is_article(d) & (F.size(F.filter(identifiers(d, "ISSN"), lambda v: _some(v).isNotNull())) == 0) & (none | F.coalesce(status.endswith("/Published"), F.lit(False))),
    }


def may_autoclassify(d: Column) -> Column:
    """From 2012 on, with a summary of 200 letters or more, published or without status, and no code below the first level."""
    status, none = publication_status(d, only=True), F.size(_notes(d, "PublicationStatus")) == 0
    return F.coalesce((publication_year(d) >= 2012) & (F.length(summary(d)) >= 200) & (none | status.endswith("/Published")) & ~is_classified(d), F.lit(False))


def cleaned_text(c: Column) -> Column:
    """Markup and its entities gone, runs of control characters as one space."""
    x = F.regexp_replace(c, "&lt;", "<")
    x = F.regexp_replace(x, "&gt;", ">")
    x = F.regexp_replace(x, "(?s)<!--.*?-->|</?[A-Za-z][^>]*(>|$)", "")
    for entity, mark in (("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.regexp_replace(x, entity, mark)
    x = F.regexp_replace(x, "[\\x07\\x08\\f\\n\\r\\t\\x0B]+", " ")
    return F.regexp_replace(x, "[\\x01-\\x1F]", "")
