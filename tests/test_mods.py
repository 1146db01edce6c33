import json

import pytest
from pyspark.sql import functions as F

from pubspark.functions import documents, mods

FULL = """<mods xmlns="http://www.loc.gov/mods/v3"><recordInfo><recordContentSource>org</recordContentSource></recordInfo><genre authority="types" type="publicationType">art</genre>
<genre authority="types" type="contentType">ref</genre><language><languageTerm type="code" authority="iso639-2b">eng</languageTerm></language><titleInfo><title>Main &amp; more</title><subTitle>Sub</subTitle></titleInfo>
<abstract lang="en">A summary</abstract><name type="personal"><namePart type="family">Lee</namePart><namePart type="given">Ann</namePart><role><roleTerm type="code" authority="marcrelator">aut</roleTerm></role>
<nameIdentifier type="orcid">0000</nameIdentifier><affiliation>Dept</affiliation></name><note type="creatorCount">1</note><identifier type="uri">http://a/1</identifier><identifier type="isbn" invalid="yes">12</identifier>
<identifier type="eissn" displayLabel="e">1234-5678</identifier><identifier type="own">x</identifier><subject lang="swe" authority="uka.se" href="10201"><topic>Computing</topic></subject><subject lang="eng"><topic>lamps</topic></subject>
<originInfo><dateIssued>2020</dateIssued><publisher>P</publisher></originInfo><relatedItem type="host"><titleInfo><title>Journal</title></titleInfo><identifier type="issn">0000-0000</identifier></relatedItem>
<accessCondition>gratis</accessCondition><location><url note="free" usage="primary">http://a/f</url></location></mods>"""


@pytest.fixture(scope="module")
def doc(spark):
    df = spark.createDataFrame([("oai:1", FULL)], "i string, x string").select("i", mods.parse(F.col("x")).alias("m"))
    return df.select(documents.parse(mods.convert(F.col("i"), F.col("m"), "v:/", "own.se", "types")).alias("d"), mods.violations(F.col("m"), "own.se", "types").alias("bad")).cache()


def test_converts(doc):
    d = F.col("d")
    want = {
        "title": (documents.title(d), "Main & more: Sub"), "year": (documents.publication_year(d), 2020), "out": (documents.output_types(d), ["v:/output/publication/journal-article"]), "mark": (documents.content_marking(d), "ref"),
        "count": (documents.creator_count(d), 1), "status": (documents.search_status(d), "published"), "issn": (documents.identifiers(d, "ISSN"), ["0000-0000", "1234-5678"]), "uri": (documents.archive_uri(d), "http://a/1"),
        "summary": (documents.summary(d), "A summary"), "lang": (documents.languages(d), ["eng"]), "subjects": (documents.subjects(d), ["1", "102", "10201"]), "keywords": (documents.keywords(d), ["lamps"]), "publisher": (documents.publisher(d), "P"),
        "channel": (documents.publication_channel(d), "Journal"), "open": (documents.open_access(d, F.lit("2020-01-01").cast("date")), True), "wrong": (d["incorrectlyIdentifiedBy"][0]["value"], "12"), "org": (d["meta"]["assigner"]["label"], "org"),
    }
    row = doc.select(*(c.alias(k) for k, (c, _) in want.items()), documents.creators(d).alias("who"), "bad").first()
    assert {k: row[k] for k in want} == {k: v for k, (_, v) in want.items()}
    assert [(c.given_name, c.family_name, c.orcid, c.affiliations) for c in row["who"]] == [("Ann", "Lee", "0000", ["Dept"])]
    assert row["bad"] == []


@pytest.mark.parametrize(
    ("old", "new", "bad"),
    [
        (">org<", "> .- <", ["recordContentSourceViolation"]), (">aut<", ">ill<", ["nameViolation"]), ("Main &amp; more", "?", ["titleViolation"]), (">art<", ">zzz<", ["publicationOrOutputTypeViolation"]), (">ref<", "><", ["contentTypeViolation"]),
        ("<dateIssued>2020</dateIssued>", "", ["publicationDateViolation"]), ("http://a/1", "", ["uriViolation"]), ("iso639-2b", "x", ["languageViolation"]), (">Journal<", "><", ["relatedItemTypeMissing"]), (">art<", ">bok<", ["relatedItemTypeViolation"]),
    ],
)
def test_rules(spark, old, new, bad):
    df = spark.createDataFrame([(FULL.replace(old, new),)], "x string")
    assert df.select(mods.violations(mods.parse(F.col("x")), "own.se", "types")).first()[0] == bad


def test_missing(spark):
    df = spark.createDataFrame([(None,)], "x string")
    assert df.select(mods.violations(mods.parse(F.col("x")), "own.se", "types")).first()[0] == ["modsDataMissing"]


MORE = """<mods><recordInfo><recordContentSource authority="src">org</recordContentSource></recordInfo><physicalDescription><form authority="marcform">electronic</form><extent>12 p.</extent></physicalDescription>
<abstract lang="swe">S</abstract><subject authority="sao" valueURI="t:3" lang="swe"><topic>Over</topic><topic>Mid "x"</topic><topic>Low</topic></subject><subject><topic>one</topic></subject>
<originInfo><publisher>P</publisher><place><placeTerm>Lund</placeTerm></place><dateIssued>2020</dateIssued><edition>2</edition><copyrightDate>2019</copyrightDate><dateOther type="defence">2020-05-01</dateOther><dateOther type="online">2020-02</dateOther>
<dateOther type="openAccess" point="start">2021</dateOther></originInfo><originInfo eventType="publication"><agent><namePart>Q</namePart><role><roleTerm>pbl</roleTerm></role></agent></originInfo><originInfo eventType="publication"/>
<originInfo eventType="manufacture"><agent><namePart>M</namePart><role><roleTerm valueURI="r:/mfr">maker</roleTerm></role></agent></originInfo><originInfo eventType="production"><agent><namePart>no</namePart><role><roleTerm>pbl</roleTerm></role></agent></originInfo>
<originInfo eventType="distribution"><agent><namePart>D</namePart><role><roleTerm>dst</roleTerm></role></agent><place><placeTerm>Oslo</placeTerm></place></originInfo><originInfo><agent><namePart>F</namePart><role><roleTerm>fnd</roleTerm></role></agent></originInfo>
<relatedItem type="constituent"><titleInfo><title>Part</title></titleInfo></relatedItem><relatedItem type="host"><genre>dataset</genre></relatedItem><relatedItem type="series"><titleInfo><title>Row</title></titleInfo></relatedItem>
<accessCondition type="use and reproduction" href="l:by">CC</accessCondition><accessCondition type="restriction on access" displayLabel="embargo">2030-01-01</accessCondition><accessCondition valueURI="v:x">gratis</accessCondition>
<accessCondition>restricted</accessCondition><accessCondition>ask</accessCondition></mods>"""


def test_converts_origins_parts_and_terms(spark):
    df = spark.createDataFrame([(MORE,), ("<mods/>",)], "x string")
    doc, empty = (json.loads(r[0]) for r in df.select(mods.convert(F.lit("i"), mods.parse(F.col("x")), "v:/", "own.se", "types", roles="r:/", policy="p:/", tags={"swe": "sv"})).collect())
    named = lambda kind, label: {"@type": kind, "label": label}
    want = {
        "publication": [{"@type": "Publication", "agent": named("Agent", "P"), "place": named("Place", "Lund"), "date": "2020"}, {"@type": "Publication", "agent": named("Agent", "Q")}],
        "manufacture": [{"@type": "Manufacture", "agent": named("Agent", "M")}], "distribution": [{"@type": "Distribution", "agent": named("Agent", "D"), "place": named("Place", "Oslo")}],
        "contribution": [{"@type": "Contribution", "agent": {"@type": "Agent", "label": "M", "role": [{"@id": "r:/mfr"}]}}, {"@type": "Contribution", "agent": {"@type": "Agent", "label": "F", "role": [{"@id": "r:/fnd"}]}}],
        "dissertation": [{"@type": "Dissertation", "date": "2020-05-01"}], "provisionActivity": [{"@type": "OnlineAvailability", "date": "2020-02"}, {"@type": "OpenAccessAvailability", "startDate": "2021"}],
        "editionStatement": "2", "copyright": [{"@type": "Copyright", "date": "2019"}], "carrierType": {"@type": "CarrierType", "label": "electronic", "source": {"@type": "Source", "code": "marcform"}}, "extent": named("Extent", "12 p."),
        "usageAndAccessPolicy": [{"@id": "l:by"}, {"@type": "Embargo", "endDate": "2030-01-01"}, {"@id": "v:x"}, {"@id": "p:/oa/restricted"}, {"@type": "AccessPolicy", "label": "ask"}],
    }
    assert {k: doc.get(k) for k in want} == want and "production" not in doc and "hasSeries" not in doc
    assert doc["hasPart"][0]["@type"] == "Resource" and doc["hasPart"][0]["hasTitle"][0]["mainTitle"] == "Part"
    assert doc["isPartOf"][0]["@type"] == "Dataset" and "genreForm" not in doc["isPartOf"][0] and doc["isPartOf"][0]["hasSeries"][0]["hasTitle"][0]["mainTitle"] == "Row"
    assert doc["meta"]["source"] == {"@type": "Source", "value": "src"} and doc["instanceOf"]["summary"][0]["language"]["code"] == "swe"
    low, one = doc["instanceOf"]["subject"]
    assert (low["@id"], low["prefLabel"], low["language"], low["inScheme"]["code"]) == ("t:3", "Low", {"code": "sv"}, "sao")
    assert low["broader"] == {"prefLabel": 'Mid "x"', "broader": {"prefLabel": "Over"}} and "broader" not in one and one["prefLabel"] == "one"
    assert empty["publication"] == [] and not {"manufacture", "contribution", "dissertation", "carrierType", "extent", "copyright", "hasPart"} & set(empty)
