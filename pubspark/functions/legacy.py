"""The older, MARC-like form of a merged record, as column expressions over one struct: no shuffle, no Python.

``parse`` reads a record's JSON text by ``SCHEMA``; ``project`` gives the older
form as JSON text. Names and addresses that belong to one system are given by
``Terms``; "today" is a parameter, never the clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_T, _I = "`@type`:string", "`@id`:string"
_IDS = f"array<struct<{_T},value:string,typeNote:string,source:struct<{_T},code:string>>>"
_NOTE = f"array<struct<{_T},label:string>>"
_TITLE = f"array<struct<{_T},mainTitle:string,subtitle:string,partNumber:string,volumeNumber:string,issueNumber:string>>"
_SCHEME = f"struct<{_I},{_T},code:string>"
_LANG = f"struct<{_T},{_I},code:string>"
_TOP = "code:string,prefLabel:string,prefLabelByLang:map<string,string>"
_BROADER = f"struct<{_TOP},broader:struct<{_TOP}>>"
_PLACE = f"{_T},name:string,nameByLang:map<string,string>,identifiedBy:{_IDS}"
_AFFIL = f"array<struct<{_PLACE},hasAffiliation:array<struct<{_PLACE},hasAffiliation:array<struct<{_PLACE}>>>>>>"
SCHEMA = (
    f"struct<{_I},meta:struct<creationDate:string,assigner:struct<label:string>>,instanceOf:struct<genreForm:array<struct<{_I}>>,hasTitle:{_TITLE},hasNote:{_NOTE},"
    f"subject:array<struct<{_I},{_T},code:string,prefLabel:string,prefLabelByLang:map<string,string>,inScheme:{_SCHEME}>>,classification:array<struct<{_I},{_T},code:string,prefLabel:string,prefLabelByLang:map<string,string>,inScheme:{_SCHEME},broader:{_BROADER}>>,"
    f"contribution:array<struct<{_T},agent:struct<{_T},name:string,familyName:string,givenName:string,termsOfAddress:string,identifiedBy:{_IDS}>,role:array<struct<{_I}>>,hasAffiliation:{_AFFIL}>>>,"
    f"identifiedBy:{_IDS},hasSeries:array<struct<hasTitle:{_TITLE},identifiedBy:{_IDS}>>,publication:array<struct<{_T},date:string,place:struct<label:string>,agent:struct<{_T},label:string>>>,"
    f"isPartOf:array<struct<{_T},genreForm:array<struct<{_I}>>,hasTitle:{_TITLE},identifiedBy:{_IDS},hasInstance:struct<extent:array<struct<label:string>>>>>,"
    f"electronicLocator:array<struct<{_T},uri:string,locator:string,label:string,hasNote:{_NOTE}>>,_publication_ids:array<string>,_publication_orgs:array<string>>"
)

# Kinds of publication by the end of the output type's address.
KINDS = {
    "publication/editorial-letter": ["art"], "publication/journal-article": ["art"], "publication/magazine-article": ["art"], "publication/newspaper-article": ["art"], "publication/book": ["bok"],
    "publication/doctoral-thesis": ["dok"], "publication/review-article": ["for"], "publication/book-chapter": ["kap"], "publication/encyclopedia-entry": ["kap"], "publication/foreword-afterword": ["kap"],
    "publication/report-chapter": ["kap"], "artistic-work": ["kfu"], "artistic-work/original-creative-work": ["kfu"], "artistic-work/artistic-thesis": ["kfu", "dok"], "conference": ["kon"],
    "conference/other": ["kon"], "conference/paper": ["kon"], "conference/poster": ["kon"], "publication/licentiate-thesis": ["lic"], "other": ["ovr"], "other/data-set": ["ovr"], "other/software": ["ovr"],
    "publication": ["ovr"], "publication/critical-edition": ["ovr"], "publication/journal-issue": ["ovr"], "publication/other": ["ovr"], "publication/preprint": ["ovr"], "publication/working-paper": ["ovr"],
    "intellectual-property": ["pat"], "intellectual-property/other": ["pat"], "intellectual-property/patent": ["pat"], "conference/proceeding": ["pro"], "publication/report": ["rap"],
    "publication/book-review": ["rec"], "publication/edited-book": ["sam"],
}
# Kinds that are parts of something else; all others are monographs.
PARTS = ["art", "for", "rec", "kap", "kon"]
# The six top subjects' names in capitals.
TOPS = {
    "en": {"1": "NATURAL SCIENCES", "2": "ENGINEERING AND TECHNOLOGY", "3": "MEDICAL AND HEALTH SCIENCES", "4": "AGRICULTURAL SCIENCES", "5": "SOCIAL SCIENCES", "6": "HUMANITIES"},
    "sv": {"1": "NATURVETENSKAP", "2": "TEKNIK OCH TEKNOLOGIER", "3": "MEDICIN OCH HÄLSOVETENSKAP", "4": "LANTBRUKSVETENSKAPER", "5": "SAMHÄLLSVETENSKAP", "6": "HUMANIORA"},
}
# The note and the text of a link to an organisation's own archive.
ARCHIVE_NOTE, ARCHIVE_TEXT = "lärosäteslänk", "Till lärosätets ({}) databas"


@dataclass
class Terms:
    """One system's names: all that the older form says about it."""

    system: str
    sigel: str
    library: str  # what library addresses begin with
    output: str  # what output types begin with
    content: str  # what content types begin with
    languages: str
    relators: str
    subjects: str  # the scheme that subjects are given in
    schemes: tuple[str, ...]  # what the addresses of the national subjects' schemes begin with
    resolver: str  # what precedes an urn in a link
    own: str  # the code of the source whose organisations go first


def parse(json: Column) -> Column:
    return F.from_json(json, SCHEMA)


def _all(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _unless_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _map(c: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c)


def kinds(d: Column, t: Terms) -> Column:
    """The genres' kinds of publication, in order; one genre may have two."""
    table = F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(t.output + k), F.array(*map(F.lit, v)))))
    return F.flatten(F.transform(_all(d["instanceOf"]["genreForm"]), lambda g: F.coalesce(F.try_element_at(table, F.coalesce(g["@id"], F.lit(""))), F.array().cast("array<string>"))))


def issuance(d: Column, t: Terms) -> Column:
    """007"""
    first = F.get(kinds(d, t), F.lit(0))
    return F.when(first.isin(PARTS), "ComponentPart").when(first.isNotNull(), "Monograph")


def year_of(date: Column, today: Column) -> Column:
    """The year of a date in one of two forms, else the present one."""
    good = F.when(date.rlike("^[0-9]{4}$"), date).when(date.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & date.try_cast("date").isNotNull(), F.left(date, F.lit(4)))
    return F.coalesce(good, F.year(today).cast("string"))


def meta(d: Column, t: Terms, today: Column) -> Column:
    """001, 003, 008, 009, 040 and 042"""
    label = F.coalesce(d["meta"]["assigner"]["label"], F.lit("None"))
    library = lambda o: F.struct(F.concat(F.lit(t.library), o).alias("@id"), F.lit("Library").alias("@type"), F.concat(F.lit(f"({t.system})"), o).alias("sigel"))
    orgs = _all(d["_publication_orgs"])
    others = F.filter(orgs, lambda o: ~o.eqNullSafe(d["meta"]["assigner"]["label"]))
    ids = F.filter(_all(d["_publication_ids"]), lambda i: i != d["@id"])
    created = F.date_format(F.coalesce(F.left(d["meta"]["creationDate"], F.lit(10)).try_cast("date"), today), "yyMMdd")
    return F.struct(
        d["meta"]["creationDate"].alias("creationDate"), d["meta"]["assigner"].alias("assigner"), d["@id"].alias("controlNumber"), F.lit(t.system).alias("systemName"), created.alias("created"), F.lit("marc:New").alias("recordStatus"),
        _unless_empty(ids).alias("marc:relatedIdentifier"), library(label).alias("descriptionCreator"), F.when(F.size(orgs) > 1, _unless_empty(F.transform(others, library))).alias("descriptionUpgrader"),
        F.array(F.struct(F.lit("Bibliography").alias("@type"), F.lit(t.sigel).alias("sigel"))).alias("bibliography"),
    )


def publications(d: Column, today: Column) -> Column:
    """008: dates as years; if no publication has a date, the first gets that of the record's making."""
    rows = _all(d["publication"])
    mine = lambda p: F.coalesce(p["@type"] == "Publication", F.lit(False))
    dated = F.exists(rows, lambda p: F.coalesce(mine(p) & (p["date"] != ""), F.lit(False)))
    first = F.array_position(F.transform(rows, mine), F.lit(True)) - 1

    def one(p: Column, i: Column) -> Column:
        guess = F.when(~dated & (i == first), year_of(d["meta"]["creationDate"], today))
        year = F.when(mine(p), F.when(_some(p["date"]).isNotNull(), year_of(p["date"], today)).otherwise(guess))
        return F.struct(F.when(mine(p), "PrimaryPublication").otherwise(p["@type"]).alias("@type"), year.alias("year"), F.when(~mine(p), p["date"]).alias("date"), p["place"].alias("place"), p["agent"].alias("agent"))

    return _unless_empty(F.transform(rows, one))


def identifiers(d: Column, t: Terms) -> Column:
    """024: DOIs, URIs and urns are plain identifiers that say their kind; urns lose their resolver's address."""
    def one(x: Column) -> Column:
        urn = F.coalesce(x["value"].startswith(t.resolver), F.lit(False))
        plain = urn | F.coalesce(x["@type"].isin("DOI", "URI"), F.lit(False))
        value = F.when(urn, F.substring(x["value"], F.instr(x["value"], "=") + 1, F.length(x["value"]))).otherwise(x["value"])
        return F.struct(F.when(plain, "Identifier").otherwise(x["@type"]).alias("@type"), value.alias("value"), F.when(urn, "urn").when(plain, x["@type"]).otherwise(x["typeNote"]).alias("typeNote"), x["source"].alias("source"))

    return F.transform(_all(d["identifiedBy"]), one)


def series(d: Column) -> Column:
    """490, if the first series has a title"""
    def one(s: Column) -> Column:
        mains = F.filter(F.transform(_all(s["hasTitle"]), lambda x: _some(x["mainTitle"])), lambda x: x.isNotNull())
        numbers = F.filter(F.transform(_all(s["hasTitle"]), lambda x: _some(x["partNumber"])), lambda x: x.isNotNull())
        inside = F.when(F.size(_all(s["identifiedBy"])) > 0, F.struct(F.lit("Instance").alias("@type"), s["identifiedBy"].alias("identifiedBy")))
        return F.struct(F.lit("SeriesMembership").alias("@type"), F.lit("0").alias("marc:seriesTracingPolicy"), _unless_empty(mains).alias("seriesStatement"), F.get(numbers, F.size(numbers) - 1).alias("seriesEnumeration"), inside.alias("inSeries"))

    return F.when(F.size(_all(F.get(_all(d["hasSeries"]), F.lit(0))["hasTitle"])) > 0, F.transform(d["hasSeries"], one))


def _language(lang: Column, t: Terms) -> Column:
    code = F.when(lang == "en", "eng").otherwise("swe")
    return F.struct(F.lit("Language").alias("@type"), F.concat(F.lit(t.languages), code).alias("@id"), code.alias("code"))


def national(x: Column, t: Terms) -> Column:
    scheme = F.coalesce(x["inScheme"]["@id"], F.lit(""))
    out = F.lit(False)
    for s in t.schemes:
        out = out | scheme.startswith(s)
    return out


def _by_lang(x: Column, langs: list[Column]) -> Column:
    """A concept's name in the first of the languages that it has one in, else any, else the plain one."""
    names = x["prefLabelByLang"]
    return F.coalesce(*(F.try_element_at(names, lang) for lang in langs), F.get(F.map_values(names), F.lit(0)), x["prefLabel"])


_SUBJECT = f"struct<{_I},{_T},code:string,prefLabel:string,label:string,language:{_LANG},inScheme:{_SCHEME},termComponentList:array<struct<{_T},prefLabel:string>>,broader:struct<prefLabel:string,broader:struct<prefLabel:string>>>"


def subjects(d: Column, t: Terms) -> Column:
    """072, 650 and 653: the subjects, the genres' content types and kinds of publication, and the national subjects in each language."""
    def free(s: Column) -> Column:
        own = national(s, t)
        lang = F.get(F.map_keys(s["prefLabelByLang"]), F.size(F.map_keys(s["prefLabelByLang"])) - 1)
        name = _by_lang(s, [F.lit("sv"), F.lit("en")])
        return F.struct(
            s["@id"].alias("@id"), s["@type"].alias("@type"), s["code"].alias("code"), F.when(own | s["prefLabelByLang"].isNotNull(), s["prefLabel"]).alias("prefLabel"), F.when(~own, name).alias("label"),
            F.when(~own & lang.isNotNull(), _language(lang, t)).alias("language"), s["inScheme"].alias("inScheme"), _none(f"array<struct<{_T},prefLabel:string>>").alias("termComponentList"), _none("struct<prefLabel:string,broader:struct<prefLabel:string>>").alias("broader"),
        ).cast(_SUBJECT)

    def concept(label: Column, code: str) -> Column:
        scheme = F.struct(_none().alias("@id"), F.lit("ConceptScheme").alias("@type"), F.lit(code).alias("code"))
        return F.struct(_none().alias("@id"), F.lit("Concept").alias("@type"), _none().alias("code"), _none().alias("prefLabel"), label.alias("label"), _none(_LANG).alias("language"), scheme.alias("inScheme"),
                        _none(f"array<struct<{_T},prefLabel:string>>").alias("termComponentList"), _none("struct<prefLabel:string,broader:struct<prefLabel:string>>").alias("broader")).cast(_SUBJECT)

    def of_genre(g: Column) -> Column:
        table = F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(t.output + k), F.array(*map(F.lit, v)))))
        told = F.coalesce(F.try_element_at(table, F.coalesce(g["@id"], F.lit(""))), F.array().cast("array<string>"))
        content = F.coalesce(g["@id"].startswith(t.content), F.lit(False))
        return F.when(content, F.array(concept(F.element_at(F.split(g["@id"], "/"), -1), f"{t.system.lower()}-contenttype"))).otherwise(F.transform(told, lambda k: concept(k, f"{t.system.lower()}-publicationtype")))

    def names(c: Column) -> Column:
        def one(e: Column) -> Column:
            lang, name = e["key"], e["value"]
            code = F.when(lang == "en", "eng").otherwise("swe")
            top = lambda x: F.coalesce(*(F.when(lang == k, _map(x["code"], v)) for k, v in TOPS.items()))
            up, above = c["broader"], c["broader"]["broader"]
            part = lambda kind, label: F.struct(F.lit(kind).alias("@type"), label.alias("prefLabel"))
            said = lambda x: F.coalesce(F.when(_by_lang(x, [lang]).isNotNull(), top(x)), _by_lang(x, [lang]))
            chain = F.array(F.when(above.isNotNull() & said(above).isNotNull(), part("Topic", said(above))), F.when(said(up).isNotNull(), F.when(above.isNull(), part("Topic", said(up))).otherwise(part("TopicSubdivision", said(up)))))
            chain = F.concat(F.filter(chain, lambda x: x.isNotNull()), F.array(part("TopicSubdivision", name)))
            parts = F.when(up.isNotNull(), chain).otherwise(F.array(part("Topic", F.coalesce(top(c), name))))
            label = lambda x: F.coalesce(F.try_element_at(x["prefLabelByLang"], lang), F.lit(""))
            broader = F.when(up.isNotNull(), F.struct(label(up).alias("prefLabel"), F.when(above.isNotNull(), F.struct(label(above).alias("prefLabel"))).alias("broader")))
            scheme = F.struct(F.lit(t.subjects).alias("@id"), F.lit("ConceptScheme").alias("@type"), F.concat(F.lit("hsv//"), code).alias("code"))
            own = F.coalesce(c["code"], F.lit(""))
            return F.struct(F.concat(F.lit(f"({t.system})"), own).alias("@id"), F.lit("ComplexSubject").alias("@type"), own.alias("code"), name.alias("prefLabel"), _none().alias("label"), _language(lang, t).alias("language"),
                            scheme.alias("inScheme"), parts.alias("termComponentList"), broader.alias("broader")).cast(_SUBJECT)

        return F.transform(F.map_entries(F.coalesce(c["prefLabelByLang"], F.create_map().cast("map<string,string>"))), one)

    work = d["instanceOf"]
    old = F.transform(_all(work["subject"]), free)
    new = F.array_distinct(F.flatten(F.transform(_all(work["genreForm"]), of_genre)))
    said = F.flatten(F.transform(F.filter(_all(work["classification"]), lambda c: national(c, t)), names))
    return F.concat(old, F.filter(new, lambda x: ~F.array_contains(old, x)), said)


def _places(c: Column) -> Column:
    """All organisations of a contribution's affiliations, each before those inside it."""
    plain = lambda a: F.struct(*(a[k].alias(k) for k in ("@type", "name", "nameByLang", "identifiedBy")))
    two = lambda a: F.concat(F.array(plain(a)), F.transform(_all(a["hasAffiliation"]), plain))
    every = F.flatten(F.transform(_all(c["hasAffiliation"]), lambda a: F.concat(F.array(plain(a)), F.flatten(F.transform(_all(a["hasAffiliation"]), two)))))
    return F.filter(every, lambda a: F.coalesce((a["@type"] == "Organization") & ((a["name"] != "") | (F.size(a["nameByLang"]) > 0)), F.lit(False)))


def _own(a: Column, t: Terms) -> Column:
    return F.exists(_all(a["identifiedBy"]), lambda i: F.coalesce((i["@type"] == "URI") & (i["source"]["@type"] == "Source") & (i["source"]["code"] == t.own), F.lit(False)))


def _name(a: Column) -> Column:
    return F.coalesce(_some(a["name"]), _some(F.try_element_at(a["nameByLang"], F.lit("swe"))), _some(F.try_element_at(a["nameByLang"], F.lit("eng"))))


def affiliation_text(c: Column, t: Terms) -> Column:
    """The names of a contribution's organisations in one text, those of the own source first; a name that holds a comma is looked for by its parts."""
    def add(text: Column, a: Column) -> Column:
        had = F.when(F.coalesce(text, F.lit("")) != "", F.split(text, ",")).otherwise(F.array().cast("array<string>"))
        names = F.filter(F.array(a["name"], F.try_element_at(a["nameByLang"], F.lit("swe")), F.try_element_at(a["nameByLang"], F.lit("eng"))), lambda n: n.isNotNull())
        put = lambda acc, n: F.when(F.array_contains(acc, n), acc).when(_own(a, t), F.concat(F.array(n), acc)).otherwise(F.concat(acc, F.array(n)))
        return F.array_join(F.aggregate(names, had, put), ",")

    return F.aggregate(_places(c), _none(), add)


def contributions(d: Column, t: Terms) -> Column:
    """100, 700 and 710: persons with their roles' codes and organisations, the first author as the primary one, and one organisation for all."""
    rows = _all(d["instanceOf"]["contribution"])
    person = lambda c: F.coalesce(c["agent"]["@type"] == "Person", F.lit(False))
    code = lambda r: F.element_at(F.split(r["@id"], "/"), -1)
    author = lambda c: person(c) & F.exists(_all(c["role"]), lambda r: F.coalesce(code(r).isin("aut", "cre"), F.lit(False)))
    first = F.array_position(F.transform(rows, author), F.lit(True)) - 1

    def one(c: Column, i: Column) -> Column:
        a, told = c["agent"], person(c) & (F.size(_all(c["hasAffiliation"])) > 0)
        local = F.filter(_all(a["identifiedBy"]), lambda x: F.coalesce((x["@type"] == "Local") & (x["source"]["code"] != ""), F.lit(False)))
        last = F.get(local, F.size(local) - 1)
        uri = F.when(told & last.isNotNull(), F.concat(F.lit(f"({t.system.capitalize()}:"), last["source"]["code"], F.lit(")"), last["value"]))
        agent = F.struct(*(a[k].alias(k) for k in ("@type", "name", "familyName", "givenName", "termsOfAddress", "identifiedBy")), F.when(told, affiliation_text(c, t)).alias("marc:affiliation"),
                         F.when(told, a["termsOfAddress"]).alias("marc:titlesAndOtherWordsAssociatedWithAName"), uri.alias("marc:uri"), _none(f"struct<{_T},name:string>").alias("isPartOf"), _none("array<string>").alias("marc:subordinateUnit"))
        role = F.transform(_all(c["role"]), lambda r: F.struct(r["@id"].alias("@id"), F.when(person(c), "Role").alias("@type"), F.when(person(c), code(r)).alias("code")))
        return F.struct(F.when(i == first, "PrimaryContribution").otherwise(c["@type"]).alias("@type"), agent.alias("agent"), role.alias("role"))

    # one organisation stands for all: the first one's name, or the first two different ones as a unit and what it is part of
    places = F.flatten(F.transform(F.filter(rows, person), _places))
    head = F.get(places, F.lit(0))
    other = F.get(F.filter(places, lambda a: F.coalesce(_name(a) != _name(head), F.lit(False))), F.lit(0))
    whole, unit = F.when(_own(other, t), _name(other)).otherwise(_name(head)), F.when(_own(other, t), _name(head)).otherwise(_name(other))
    agent = F.struct(F.lit("Organization").alias("@type"), F.when(other.isNull(), _name(head)).alias("name"), *(_none().alias(k) for k in ("familyName", "givenName", "termsOfAddress")), _none(_IDS).alias("identifiedBy"),
                     *(_none().alias(k) for k in ("marc:affiliation", "marc:titlesAndOtherWordsAssociatedWithAName", "marc:uri")), F.when(other.isNotNull(), F.struct(F.lit("Organization").alias("@type"), whole.alias("name"))).alias("isPartOf"), F.when(other.isNotNull(), F.array(unit)).alias("marc:subordinateUnit"))
    role = F.array(F.struct(F.lit(t.relators + "org").alias("@id"), F.lit("Role").alias("@type"), F.lit("org").alias("code")))
    body = F.struct(F.lit("Contribution").alias("@type"), agent.alias("agent"), role.alias("role"))
    out = F.transform(rows, one)
    return F.when(head.isNotNull(), F.concat(out, F.array(body))).otherwise(out)


_HOST = f"struct<{_T},hasTitle:{_TITLE},identifiedBy:{_IDS},`marc:enumerationAndFirstPage`:string,provisionActivityStatement:string>"


def hosts(d: Column) -> Column:
    """773: a struct of ``part`` (the text for the last host) and ``hosts``. A volume begins a text anew; a host without one goes on with the text before it."""
    p = F.get(_all(d["publication"]), F.lit(0))
    said = F.concat(F.coalesce(_some(p["place"]["label"]), F.lit("")), F.when(_some(p["agent"]["label"]).isNotNull(), F.concat(F.lit(" : "), p["agent"]["label"])).otherwise(""))
    fit = F.filter(_all(d["isPartOf"]), lambda h: (F.size(_all(h["hasTitle"])) > 0) & (F.size(_all(h["genreForm"])) == 0) & (F.coalesce(h["@type"], F.lit("")) != "Dataset"))

    def add(acc: Column, h: Column) -> Column:
        title = F.get(h["hasTitle"], F.lit(0))
        volume, issue, page = _some(title["volumeNumber"]), _some(title["issueNumber"]), F.get(_all(h["hasInstance"]["extent"]), F.lit(0))["label"]
        number = F.when(issue.isNotNull(), F.concat(F.lit(":"), issue)).otherwise("")
        part = F.concat(F.coalesce(volume, acc["part"]), number, F.when(page.isNotNull(), F.concat(F.lit(", s. "), page)).otherwise(""))
        mark = F.concat(F.coalesce(volume, acc["mark"]), number, F.when(page.isNotNull(), F.concat(F.lit("<"), page)).otherwise(""))
        titles = F.transform(h["hasTitle"], lambda x, i: F.when(i == 0, x.withField("volumeNumber", _none()).withField("issueNumber", _none())).otherwise(x))
        host = F.struct(F.lit("Instance").alias("@type"), titles.alias("hasTitle"), h["identifiedBy"].alias("identifiedBy"), _some(mark).alias("marc:enumerationAndFirstPage"), _some(said).alias("provisionActivityStatement")).cast(_HOST)
        return F.struct(part.alias("part"), mark.alias("mark"), F.concat(acc["hosts"], F.array(host)).alias("hosts"))

    begin = F.struct(F.lit("").alias("part"), F.lit("").alias("mark"), F.array().cast(f"array<{_HOST}>").alias("hosts"))
    return F.aggregate(fit, begin, add)


def locators(d: Column) -> Column:
    """856: links as documents"""
    def one(e: Column) -> Column:
        uri = F.coalesce(_some(e["locator"]), _some(e["uri"]))
        notes = F.filter(F.transform(_all(e["hasNote"]), lambda n: _some(n["label"])), lambda x: x.isNotNull())
        return F.struct(F.lit("Document").alias("@type"), F.when(uri.isNotNull(), F.array(uri)).alias("uri"), e["label"].alias("label"), F.when(F.size(_all(e["hasNote"])) > 0, notes).alias("cataloguersNote"), F.when(_some(e["label"]).isNotNull(), F.array(e["label"])).alias("marc:linkText"))

    return _unless_empty(F.transform(_all(d["electronicLocator"]), one))


def related(ids: Column, t: Terms) -> Column:
    """856: each address among the identifiers (as ``identifiers`` gives them) once"""
    def one(i: Column) -> Column:
        urn, value = i["typeNote"] == "urn", F.coalesce(i["value"], F.lit(""))
        who = F.when(value.startswith("urn:nbn:se"), F.split(F.coalesce(F.get(F.split(value, ":"), F.lit(3)), F.lit("")), "-")[0]).otherwise("")
        head, tail = ARCHIVE_TEXT.split("{}")
        uri = F.when(urn, F.concat(F.lit(t.resolver), value)).when((i["typeNote"] == "DOI") & ~value.startswith("http"), F.concat(F.lit("https://doi.org/"), value)).otherwise(value)
        return F.struct(F.lit("Document").alias("@type"), F.when(urn, F.array(F.concat(F.lit(head), who, F.lit(tail)))).alias("marc:linkText"), F.when(urn, F.array(F.lit(ARCHIVE_NOTE))).alias("cataloguersNote"), F.array(uri).alias("uri"))

    return F.array_distinct(F.transform(F.filter(ids, lambda i: F.coalesce(i["typeNote"].isin("URI", "DOI", "urn"), F.lit(False))), one))


def project(d: Column, t: Terms, today: Column) -> Column:
    """The record in the older form, as a struct; ``to_json`` leaves out what is null."""
    work, ids, host = d["instanceOf"], identifiers(d, t), hosts(d)
    rest = _unless_empty(F.filter(_all(work["classification"]), lambda c: ~national(c, t)))
    inner = F.struct(work["genreForm"].alias("genreForm"), subjects(d, t).alias("subject"), rest.alias("classification"), contributions(d, t).alias("contribution"), work["hasNote"].alias("hasNote"))
    return F.struct(
        d["@id"].alias("@id"), meta(d, t, today).alias("meta"), issuance(d, t).alias("issuanceType"), inner.alias("instanceOf"), _unless_empty(_all(work["hasTitle"])).alias("hasTitle"), publications(d, today).alias("publication"),
        _unless_empty(ids).alias("identifiedBy"), d["hasSeries"].alias("hasSeries"), series(d).alias("seriesMembership"), _unless_empty(F.filter(_all(work["hasNote"]), lambda n: F.coalesce(n["@type"] == "Note", F.lit(False)))).alias("hasNote"),
        F.when(host["part"] != "", F.array(host["part"])).alias("part"), _unless_empty(host["hosts"]).alias("isPartOf"), locators(d).alias("electronicLocator"), F.when(F.size(ids) > 0, related(ids, t)).alias("relatedTo"),
    )
