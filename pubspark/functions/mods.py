"""MODS records: from XML to the document of ``documents``, and the rules that a record must meet, all by built-in functions.

``parse`` reads the XML text, ``violations`` names the rules that it breaks and
``convert`` gives the document's JSON text. Terms get the address of a
vocabulary, which is a parameter. Names within names beyond one level of
affiliation, series parts and dissertation notes are not converted. Topics above
a subject's own are nested as deep as they come, as a variant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT = "_VALUE:string,_type:string,_authority:string,_valueURI:string,_lang:string"
_T = f"array<struct<{_TEXT}>>"
_TITLE = f"array<struct<_type:string,title:{_T},subTitle:{_T}>>"
_IDS = "array<struct<_VALUE:string,_type:string,_invalid:string,_displayLabel:string>>"
_NAME = f"array<struct<_type:string,_authority:string,namePart:{_T},affiliation:{_T},nameIdentifier:array<struct<_VALUE:string,_type:string,_invalid:string>>,role:array<struct<roleTerm:{_T}>>>>"
SCHEMA = (
    f"struct<recordInfo:array<struct<recordContentSource:{_T},recordCreationDate:{_T},recordChangeDate:{_T}>>,typeOfResource:{_T},genre:{_T},language:array<struct<languageTerm:{_T}>>,titleInfo:{_TITLE},"
    f"abstract:{_T},name:{_NAME},note:{_T},identifier:{_IDS},subject:array<struct<_lang:string,_authority:string,_href:string,_valueURI:string,topic:{_T}>>,physicalDescription:array<struct<form:{_T},extent:{_T}>>,"
    f"originInfo:array<struct<_eventType:string,dateIssued:{_T},publisher:{_T},agent:array<struct<namePart:{_T},role:array<struct<roleTerm:{_T}>>>>,place:array<struct<placeTerm:{_T}>>,dateOther:array<struct<_VALUE:string,_type:string,_point:string>>,edition:{_T},copyrightDate:{_T}>>,"
    f"accessCondition:array<struct<_VALUE:string,_type:string,_displayLabel:string,_valueURI:string,_href:string>>,location:array<struct<url:array<struct<_VALUE:string,_displayLabel:string,_note:string,_usage:string,_access:string>>>>,"
    f"relatedItem:array<struct<_type:string,titleInfo:{_TITLE},identifier:{_IDS},genre:{_T}>>>"
)

# Kinds of resource, of identifier and of output, publication statuses.
RESOURCES = {
    "text": "Text", "stillimage": "StillImage", "sound recording - nonmusical": "NonMusicalAudio", "sound recording - musical": "Music", "sound recording": "Audio", "software, multimedia": "Multimedia",
    "notated music": "NotatedMusic", "mixed material": "MixedMaterial", "cartographic": "Cartography", "three dimensional object": "Object", "moving image": "MovingImage",
}
IDENTIFIERS = {
    "doi": "DOI", "hdl": "Hdl", "isbn": "ISBN", "ocolc": "WorldCatNumber", "worldcat": "WorldCatNumber", "patent_number": "PatentNumber", "pmid": "PMID",
    "scopus": "ScopusID", "isi": "ISI", "issue number": "IssueNumber", "issn": "ISSN", "eissn": "ISSN", "orcid": "ORCID", "uri": "URI", "urn": "URN", "urn:nbn": "URN", "source": "Source", "isni": "ISNI",
    "swecris": "SweCRIS", "cordis": "CORDIS", "fundref": "FundRef", "ringgold": "Ringgold", "grid": "GRID", "ror": "ROR", "ROR": "ROR", "raid": "RAiD", "RAiD": "RAiD", "RAID": "RAiD",
}
TYPES = {
    "bok": "publication/book", "kon": "conference", "kap": "publication/book-chapter", "dok": "publication/doctoral-thesis", "rap": "publication/report", "rec": "publication/book-review", "sam": "publication/edited-book",
    "for": "publication/review-article", "kfu": "artistic-work", "lic": "publication/licentiate-thesis", "pat": "intellectual-property/patent", "pro": "conference/proceeding", "ovr": "publication",
}
ARTICLES = {"ref": "publication/journal-article", "vet": "publication/magazine-article", "pop": "publication/newspaper-article"}
STATUSES = {
    "Published": "Published", "Preprint": "Preprint", "Submitted": "Submitted", "Accepted": "Accepted", "In press": "InPress", "Epub ahead of print/Online first": "EpubAheadOfPrintOnlineFirst", "Retracted": "Retracted",
}
OUTPUTS = [
    "publication", "publication/book", "publication/edited-book", "publication/book-chapter", "publication/report-chapter", "publication/report", "publication/journal-article", "publication/review-article",
    "publication/doctoral-thesis", "publication/licentiate-thesis", "publication/translation", "publication/critical-edition", "publication/working-paper", "publication/editorial-letter", "publication/book-review",
    "publication/magazine-article", "publication/newspaper-article", "publication/encyclopedia-entry", "publication/journal-issue", "publication/foreword-afterword", "publication/preprint", "publication/other",
    "conference", "conference/poster", "conference/paper", "conference/proceeding", "conference/other", "intellectual-property", "intellectual-property/patent", "intellectual-property/other", "artistic-work",
    "artistic-work/original-creative-work", "artistic-work/curated-exhibition-or-event", "other", "other/data-set", "other/software", "artistic-work/artistic-thesis",
]
NO_CONTENT = [
    "intellectual-property", "intellectual-property/patent", "intellectual-property/other", "other", "other/data-set", "other/software", "artistic-work", "artistic-work/original-creative-work",
    "artistic-work/curated-exhibition-or-event", "artistic-work/artistic-thesis",
]
NO_NAME = ["artistic-work", "artistic-work/original-creative-work", "artistic-work/artistic-thesis"]
WITH_HOST = [
    "publication/book-chapter", "publication/report-chapter", "publication/journal-article", "publication/editorial-letter", "publication/magazine-article", "publication/newspaper-article",
    "publication/journal-issue", "publication/book-review", "publication/review-article", "publication/foreword-afterword",
]
WITHOUT_HOST = [
    "publication/book", "publication/edited-book", "publication/report", "publication/doctoral-thesis", "publication/licentiate-thesis", "artistic-work/artistic-thesis", "conference/proceeding",
    "intellectual-property/patent", "other/software",
]
#: What dates other than that of issue say, and the roles of an origin's agent by event.
DATES = {"available": "Availability", "digitized": "Digitization", "online": "OnlineAvailability", "openAccess": "OpenAccessAvailability"}
EVENTS = {"publication": "pbl", "manufacture": "mfr", "distribution": "dst", "production": "pro"}
PROJECTS = ["project", "initiative", "grantAgreement", "programme", "event", "dataset"]
BLANKS = '?-:;.,()[]!#€./=+$@"'


def parse(xml: Column) -> Column:
    return F.from_xml(xml, SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def _all(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _flat(c: Column, field: str) -> Column:
    return F.flatten(F.transform(_all(c), lambda x: _all(x[field])))


def _says(c: Column) -> Column:
    """Some element has more than marks and spaces."""
    return F.exists(_all(c), lambda x: F.coalesce(F.trim(F.translate(F.regexp_replace(x["_VALUE"], "\\s", " "), BLANKS, " " * len(BLANKS))) != "", F.lit(False)))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _genre(m: Column, authority: str, kind: str, values: list[str]) -> Column:
    return F.exists(_all(m["genre"]), lambda g: _true((g["_authority"] == authority) & (g["_type"] == kind) & F.trim(g["_VALUE"]).isin(values)))


def _roles(n: Column, values: list[str]) -> Column:
    return F.exists(_flat(n["role"], "roleTerm"), lambda r: _true((r["_type"] == "code") & (r["_authority"] == "marcrelator") & F.trim(r["_VALUE"]).isin(values)))


def violations(m: Column, authority: str, old: str) -> Column:
    """Codes of the rules that a record breaks, in order; ``authority`` and ``old`` name the two genre vocabularies."""
    out = lambda v: _genre(m, authority, "outputType", v)
    pub = lambda v: _genre(m, old, "publicationType", v)
    hosts = F.filter(_all(m["relatedItem"]), lambda r: _true(r["_type"] == "host"))
    organisation = ["pbl", "aut", "edt", "cre", "org"]

    def named(n: Column) -> Column:
        person = _true(n["_type"] == "personal") & _roles(n, ["aut", "edt", "cre"]) & _says(n["namePart"])
        body = _true(n["_type"] == "corporate") & _roles(n, organisation)
        own = _true(n["_authority"] != "") & _says(n["namePart"])
        return person | (body & (own | _says(F.filter(_all(n["affiliation"]), lambda a: _true(a["_authority"] != "")))))

    unpublished = F.exists(_all(m["note"]), lambda n: _true((n["_type"] == "publicationStatus") & F.trim(n["_VALUE"]).isin([s for s in STATUSES if s != "Published"])))
    language = F.exists(_flat(m["language"], "languageTerm"), lambda t: _true((t["_type"] == "code") & t["_authority"].isin("iso639-2b", "iso639-3") & (t["_VALUE"] != "")))
    has_host = _says(_flat(_flat(hosts, "titleInfo"), "title"))
    project = F.exists(_flat(hosts, "genre"), lambda g: _true(F.trim(g["_VALUE"]).isin(PROJECTS)))
    rules = {
        "recordContentSourceViolation": ~_says(_flat(m["recordInfo"], "recordContentSource")),
        "nameViolation": ~F.exists(_all(m["name"]), named) & ~out(NO_NAME),
        "titleViolation": ~_says(_flat(m["titleInfo"], "title")),
        "publicationOrOutputTypeViolation": ~pub(["art", *TYPES]) & ~out(OUTPUTS),
        "contentTypeViolation": ~_genre(m, old, "contentType", ["ref", "vet", "pop"]) & ~pub(["pat", "ovr", "kfu"]) & ~out(NO_CONTENT),
        "publicationDateViolation": ~_says(_flat(m["originInfo"], "dateIssued")) & ~unpublished & ~out(["publication/preprint"]),
        "uriViolation": ~F.exists(_all(m["identifier"]), lambda i: _true((i["_type"] == "uri") & (i["_VALUE"] != ""))),
        "languageViolation": ~language,
        "relatedItemTypeMissing": (pub(["art", "for", "kap", "rec"]) | out(WITH_HOST)) & ~has_host & ~unpublished,
        "relatedItemTypeViolation": (pub(["bok", "dok", "lic", "pat", "pro", "rap"]) | out(WITHOUT_HOST)) & has_host & ~project,
    }
    found = F.array_compact(F.array(*(F.when(broken, code) for code, broken in rules.items())))
    return F.when(m.isNull(), F.array(F.lit("modsDataMissing"))).otherwise(found)


def _pick(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    at = F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), c)
    return F.coalesce(at, F.lit(default)) if default else at


def _titles(c: Column) -> Column:
    first = lambda x, k: F.trim(F.get(_all(x[k]), F.lit(0))["_VALUE"])
    kind = lambda x: F.when(x["_type"].isNull(), "Title").otherwise("VariantTitle")
    return F.transform(_all(c), lambda x: F.struct(kind(x).alias("@type"), first(x, "title").alias("mainTitle"), first(x, "subTitle").alias("subtitle")))


def _ids(c: Column, invalid: bool = False, more: dict[str, str] | None = None) -> Column:
    kept = F.filter(_all(c), lambda i: (_true(i["_invalid"] == "yes") if invalid else ~_true(i["_invalid"] == "yes")) & _true(F.trim(i["_VALUE"]) != ""))

    def one(i: Column) -> Column:
        kind = _pick(i["_type"], IDENTIFIERS | (more or {}), "Local")
        source = F.when(kind == "Local", F.struct(F.lit("Source").alias("@type"), i["_type"].alias("code")))
        return F.struct(kind.alias("@type"), F.trim(i["_VALUE"]).alias("value"), i["_displayLabel"].alias("qualifier"), source.alias("source"))

    return F.transform(kept, one)


def _struct(**fields: Column) -> Column:
    return F.struct(*(v.alias(k.replace("at_", "@")) for k, v in fields.items()))


def _text(c: Column) -> Column:
    """The first element's text."""
    return F.trim(F.get(_all(c), F.lit(0))["_VALUE"])


def _labelled(kind: str, label: Column) -> Column:
    return F.when(label.isNotNull(), F.struct(F.lit(kind).alias("@type"), label.alias("label")))


def _some(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _origin(o: Column, roles: str) -> dict[str, Column]:
    """All that an instance says of its origins ``o``: events, dates and edition."""
    terms = lambda x: _flat(_flat(x["agent"], "role"), "roleTerm")
    plays = lambda x, code: F.exists(terms(x), lambda t: _true(F.trim(t["_VALUE"]) == code) | _true(t["_valueURI"] == roles + code))
    agent = lambda x: _text(_flat(x["agent"], "namePart"))
    place = lambda x: _labelled("Place", _text(_flat(x["place"], "placeTerm")))
    at = lambda x, kind: _true(x["_eventType"] == kind)

    def event(kind: str) -> Column:
        rows = F.filter(o, lambda x: at(x, kind) & plays(x, EVENTS[kind]))
        return F.transform(rows, lambda x: _struct(at_type=F.lit(kind.capitalize()), agent=_labelled("Agent", agent(x)), place=place(x)))

    told = lambda x: x["publisher"].isNotNull() | x["place"].isNotNull() | x["dateIssued"].isNotNull()
    issued = F.filter(o, lambda x: (x["_eventType"].isNull() & told(x)) | (at(x, "publication") & (told(x) | plays(x, "pbl"))))
    publication = lambda x: _struct(at_type=F.lit("Publication"), agent=_labelled("Agent", F.coalesce(agent(x), _text(x["publisher"]))), place=place(x), date=_text(x["dateIssued"]))
    known = [*EVENTS.values(), *(roles + c for c in EVENTS.values())]
    others = F.filter(o, lambda x: (F.size(terms(x)) > 0) & ~F.exists(terms(x), lambda t: _true(F.trim(t["_VALUE"]).isin(known))))

    def contribution(x: Column) -> Column:
        address = F.get(F.filter(F.transform(terms(x), lambda t: t["_valueURI"]), lambda u: u.isNotNull()), F.lit(0))
        role = F.array(F.struct(F.coalesce(address, F.concat(F.lit(roles), _text(terms(x)))).alias("@id")))
        return _struct(at_type=F.lit("Contribution"), agent=F.when(agent(x).isNotNull(), _struct(at_type=F.lit("Agent"), label=agent(x), role=role)), place=place(x))

    dates = _flat(o, "dateOther")
    defence = F.element_at(_some(F.filter(dates, lambda d: _true(d["_type"] == "defence"))), -1)
    starts = lambda d: _true(d["_point"] == "start")
    activity = lambda d: _struct(at_type=_pick(d["_type"], DATES), startDate=F.when(starts(d), F.trim(d["_VALUE"])), date=F.when(~starts(d), F.trim(d["_VALUE"])))
    copyright_ = _text(_flat(o, "copyrightDate"))
    return {
        "publication": F.transform(issued, publication), **{k: _some(event(k)) for k in EVENTS if k != "publication"}, "contribution": _some(F.transform(others, contribution)),
        "dissertation": F.when(defence.isNotNull(), F.array(_struct(at_type=F.lit("Dissertation"), date=F.trim(defence["_VALUE"])))),
        "provisionActivity": _some(F.transform(F.filter(dates, lambda d: _true(d["_type"] != "defence")), activity)), "editionStatement": _text(_flat(o, "edition")),
        "copyright": F.when(copyright_.isNotNull(), F.array(_struct(at_type=F.lit("Copyright"), date=copyright_))),
    }


def _broader(topics: Column) -> Column:
    """The topics above the last one, each within the one below it."""

    def within(inner: Column, t: Column) -> Column:
        own = F.to_json(F.struct(F.coalesce(F.trim(t["_VALUE"]), F.lit("")).alias("prefLabel")))
        return F.when(inner.isNull(), own).otherwise(F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"broader":'), inner, F.lit("}")))

    return F.parse_json(F.aggregate(F.slice(topics, F.lit(1), F.greatest(F.size(topics) - 1, F.lit(0))), F.lit(None).cast("string"), within))


def convert(oai_id: Column, m: Column, base: str, authority: str, old: str, roles: str = "http://id.loc.gov/vocabulary/relators/", identifiers: dict[str, str] | None = None, policy: str = "", tags: dict[str, str] | None = None) -> Column:
    """The document's JSON text; what is missing is left out.

    ``authority`` and ``old`` name the two genre vocabularies, ``base`` begins
    terms' addresses and ``policy`` (or ``base`` and policy/) those of access
    policies; ``identifiers`` maps a catalogue's own kinds of identifier and
    ``tags`` the languages' codes to their tags.
    """
    outputs = F.transform(F.filter(_all(m["genre"]), lambda g: _true((g["_authority"] == authority) & (g["_type"] == "outputType"))), lambda g: F.trim(g["_VALUE"]))
    marks = F.transform(F.filter(_all(m["genre"]), lambda g: _true((g["_authority"] == old) & (g["_type"] == "contentType"))), lambda g: F.trim(g["_VALUE"]))
    older = F.transform(F.filter(_all(m["genre"]), lambda g: _true((g["_authority"] == old) & (g["_type"] == "publicationType"))), lambda g: F.trim(g["_VALUE"]))
    article = _pick(F.get(marks, F.lit(0)), ARTICLES, "publication")
    mapped = F.array_compact(F.transform(older, lambda g: F.when(g == "art", article).otherwise(_pick(g, TYPES))))
    types = F.transform(F.when(F.size(outputs) > 0, outputs).otherwise(mapped), lambda g: F.concat(F.lit(f"{base}output/"), g))
    genres = F.concat(types, F.transform(marks, lambda g: F.concat(F.lit(f"{base}{old}/"), g)))
    notes = _all(m["note"])
    status = F.transform(F.filter(notes, lambda n: _true(n["_type"] == "publicationStatus")), lambda n: F.coalesce(n["_valueURI"], F.concat(F.lit(base), _pick(F.trim(n["_VALUE"]), STATUSES, "Published"))))
    status = F.when(F.size(status) == 0, F.array(F.lit(f"{base}Published"))).otherwise(status)
    note = lambda kind, i, label: F.struct(F.lit(kind).alias("@type"), i.cast("string").alias("@id"), label.cast("string").alias("label"))
    none = F.lit(None)
    every = F.concat(
        F.transform(F.filter(notes, lambda n: _true(n["_type"] == "creatorCount")), lambda n: note("CreatorCount", none, F.trim(n["_VALUE"]))),
        F.transform(status, lambda s: note("PublicationStatus", s, none)), F.transform(F.filter(notes, lambda n: n["_type"].isNull()), lambda n: note("Note", none, F.trim(n["_VALUE"]))),
    )

    def who(n: Column) -> Column:
        part = lambda k: F.trim(F.get(F.filter(_all(n["namePart"]), lambda p: _true(p["_type"] == k) if k else p["_type"].isNull()), F.lit(0))["_VALUE"])
        kind = F.when(n["_type"] == "personal", "Person").when(n["_type"] == "conference", "Meeting").otherwise("Organization")
        ids = F.transform(F.filter(_all(n["nameIdentifier"]), lambda i: i["_invalid"].isNull()), lambda i: F.struct(_pick(i["_type"], IDENTIFIERS, "Local").alias("@type"), F.trim(i["_VALUE"]).alias("value")))
        agent = _struct(at_type=kind, familyName=part("family"), givenName=part("given"), name=F.when(kind != "Person", part("")), identifiedBy=ids)
        role = F.transform(F.filter(_flat(n["role"], "roleTerm"), lambda r: _true(r["_type"] == "code")), lambda r: F.struct(F.concat(F.lit(roles), F.trim(r["_VALUE"])).alias("@id")))
        place = F.transform(_all(n["affiliation"]), lambda a: F.struct(F.lit("Organization").alias("@type"), a["_valueURI"].alias("@id"), F.trim(a["_VALUE"]).alias("name")))
        return _struct(at_type=F.lit("Contribution"), agent=agent, role=role, hasAffiliation=place)

    topics = F.filter(_all(m["subject"]), lambda s: F.size(_all(s["topic"])) > 0)
    code = lambda s: F.regexp_extract(F.coalesce(s["_href"], F.lit("")), "([0-9]+)$", 1)
    classed = F.filter(topics, lambda s: _true(s["_authority"].isNotNull()) & (code(s) != ""))
    free = F.filter(topics, lambda s: ~(_true(s["_authority"].isNotNull()) & (code(s) != "")))
    label = lambda s: F.trim(F.element_at(_some(s["topic"]), -1)["_VALUE"])
    tag = lambda c: F.coalesce(_pick(c, tags), c) if tags else c

    def topic(s: Column) -> Column:
        scheme = F.when(s["_authority"].isNotNull(), _struct(at_type=F.lit("ConceptScheme"), code=s["_authority"]))
        return _struct(at_id=s["_valueURI"], at_type=F.lit("Topic"), code=s["_href"], prefLabel=label(s), language=F.struct(tag(s["_lang"]).alias("code")), inScheme=scheme, broader=_broader(s["topic"]))

    work = _struct(
        at_type=_pick(F.lower(F.trim(F.get(_all(m["typeOfResource"]), F.lit(0))["_VALUE"])), RESOURCES, "Text"), genreForm=F.transform(genres, lambda g: F.struct(g.alias("@id"))),
        language=F.transform(_flat(m["language"], "languageTerm"), lambda t: F.struct(F.lit("Language").alias("@type"), F.trim(t["_VALUE"]).alias("code"))), hasTitle=_titles(m["titleInfo"]),
        summary=F.transform(_all(m["abstract"]), lambda a: _struct(at_type=F.lit("Summary"), label=F.trim(a["_VALUE"]), language=F.when(a["_lang"].isNotNull(), _struct(at_type=F.lit("Language"), code=a["_lang"])))), contribution=F.transform(_all(m["name"]), who),
        subject=F.transform(free, topic),
        classification=F.transform(classed, lambda s: F.struct(F.lit("Classification").alias("@type"), s["_href"].alias("@id"), code(s).alias("code"), label(s).alias("prefLabel"))), hasNote=every,
    )
    def access(a: Column) -> Column:
        text = F.trim(a["_VALUE"])
        licence = _true((a["_type"] == "use and reproduction") & (a["_href"] != ""))
        embargo = ~licence & _true((a["_type"] == "restriction on access") & (a["_displayLabel"] == "embargo"))
        address = F.when(licence, a["_href"]).when(~embargo, F.coalesce(a["_valueURI"], F.when(text.isin("gratis", "restricted"), F.concat(F.lit((policy or f"{base}policy/") + "oa/"), text))))
        kind = F.when(embargo, "Embargo").when(address.isNull(), "AccessPolicy")
        return _struct(at_type=kind, at_id=address, label=F.when(kind == "AccessPolicy", text), endDate=F.when(embargo & (text != ""), text))

    def link(u: Column) -> Column:
        said = F.array_compact(F.array(*(F.when(u[k].isNotNull(), note("Note", none, u[k])) for k in ("_usage", "_access", "_note"))))
        return _struct(at_type=F.lit("Resource"), uri=F.trim(u["_VALUE"]), label=u["_displayLabel"], hasNote=said)

    def related(r: Column, kind: str, **more: Column) -> Column:
        said = F.transform(_all(r["genre"]), lambda g: F.trim(g["_VALUE"]))
        genre = F.transform(F.filter(_all(r["genre"]), lambda g: _true(g["_valueURI"].isNotNull() | (F.trim(g["_VALUE"]) != "dataset"))), lambda g: F.struct(F.coalesce(g["_valueURI"], F.trim(g["_VALUE"])).alias("@id")))
        return _struct(at_type=F.when(F.array_contains(said, "dataset"), "Dataset").otherwise(kind), genreForm=_some(genre), hasTitle=_titles(r["titleInfo"]), identifiedBy=_ids(r["identifier"]), **more)

    of = lambda kind: F.filter(_all(m["relatedItem"]), lambda r: _true(r["_type"] == kind))
    hosts = of("host")
    series = F.transform(of("series"), lambda r: related(r, "Work"))
    part = F.transform(hosts, lambda r: related(r, "Work", hasSeries=_some(series)))
    form = _flat(m["physicalDescription"], "form")
    marc = F.exists(form, lambda f: _true(f["_authority"] == "marcform"))
    carrier = F.when(F.size(form) > 0, _struct(at_type=F.lit("CarrierType"), label=_text(form), source=F.when(marc, _struct(at_type=F.lit("Source"), code=F.lit("marcform")))))
    giver = F.get(_flat(m["recordInfo"], "recordContentSource"), F.lit(0))["_authority"]
    origin = _origin(_all(m["originInfo"]), roles)
    one = lambda k: F.trim(F.get(_flat(m["recordInfo"], k), F.lit(0))["_VALUE"])
    doc = _struct(
        at_id=oai_id, at_type=F.lit("Instance"), instanceOf=work, identifiedBy=_ids(m["identifier"], more=identifiers), incorrectlyIdentifiedBy=_ids(m["identifier"], True, identifiers), isPartOf=part,
        hasSeries=F.when((F.size(hosts) == 0) & (F.size(series) > 0), series), hasPart=_some(F.transform(of("constituent"), lambda r: related(r, "Resource"))),
        carrierType=carrier, extent=_labelled("Extent", _text(_flat(m["physicalDescription"], "extent"))), **origin, usageAndAccessPolicy=F.transform(_all(m["accessCondition"]), access),
        electronicLocator=F.transform(_flat(m["location"], "url"), link), meta=_struct(at_type=F.lit("AdminMetadata"), assigner=_labelled("Agent", one("recordContentSource")), source=F.when(giver.isNotNull(), _struct(at_type=F.lit("Source"), value=giver)), creationDate=one("recordCreationDate"), changeDate=one("recordChangeDate")),
    )
    return F.to_json(doc)
