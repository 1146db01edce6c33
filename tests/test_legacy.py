import json

from pyspark.sql import functions as F

from pubspark.functions import legacy

TERMS = legacy.Terms("Sys", "SYS", "http://lib/", "v:/output/", "v:/types/", "l:/", "r:/", "s:/uka/", ("s:/uka", "s:/ssif"), "http://urn/resolve?urn=", "own")
DOC = {
    "@id": "oai:a:1", "meta": {"creationDate": "2021-03-04T10:00:00Z", "assigner": {"label": "org1"}}, "_publication_ids": ["oai:a:1", "oai:b:2"], "_publication_orgs": ["org1", "org2"],
    "instanceOf": {
        "genreForm": [{"@id": "v:/types/ref"}, {"@id": "v:/output/artistic-work/artistic-thesis"}], "hasTitle": [{"@type": "Title", "mainTitle": "T"}], "hasNote": [{"@type": "Note", "label": "n"}, {"@type": "CreatorCount", "label": "1"}],
        "subject": [{"@type": "Topic", "prefLabelByLang": {"en": "lamps"}}, {"@type": "Topic", "prefLabel": "plain"}],
        "classification": [
            {"@id": "c", "code": "10201", "inScheme": {"@id": "s:/ssif/2025"}, "prefLabelByLang": {"en": "CS"}, "broader": {"code": "102", "prefLabelByLang": {"en": "Computing"}, "broader": {"code": "1", "prefLabelByLang": {"en": "Natural"}}}},
            {"@id": "c1", "code": "1", "inScheme": {"@id": "s:/uka/"}, "prefLabelByLang": {"sv": "Natur"}}, {"@id": "other", "code": "x"},
        ],
        "contribution": [
            {"@type": "Contribution", "agent": {"@type": "Person", "familyName": "Lee", "termsOfAddress": "Dr", "identifiedBy": [{"@type": "Local", "value": "7", "source": {"code": "a"}}]}, "role": [{"@id": "r:/edt"}],
             "hasAffiliation": [{"@type": "Organization", "name": "Dept, X", "hasAffiliation": [{"@type": "Organization", "nameByLang": {"swe": "Univ"}, "identifiedBy": [{"@type": "URI", "source": {"@type": "Source", "code": "own"}}]}]}, {"@type": "Organization", "name": "Dept, X"}]},
            {"@type": "Contribution", "agent": {"@type": "Person", "familyName": "Ek"}, "role": [{"@id": "r:/aut"}]}, {"@type": "Contribution", "agent": {"@type": "Organization", "name": "O"}, "role": [{"@id": "r:/aut"}]},
        ],
    },
    "identifiedBy": [{"@type": "DOI", "value": "10.1/a"}, {"@type": "URI", "value": "http://urn/resolve?urn=urn:nbn:se:kth:diva-1"}, {"@type": "DOI", "value": "10.1/a"}, {"@type": "ISBN", "value": "9"}],
    "hasSeries": [{"hasTitle": [{"mainTitle": "S", "partNumber": "3"}], "identifiedBy": [{"@type": "ISSN", "value": "1"}]}, {}],
    "publication": [{"@type": "Publication", "date": "", "place": {"label": "Place"}, "agent": {"label": "Pub"}}, {"@type": "Other", "date": "1"}],
    "isPartOf": [{"@type": "Work", "hasTitle": [{"mainTitle": "J", "volumeNumber": "4", "issueNumber": "2"}], "hasInstance": {"extent": [{"label": "5-6"}]}}, {"@type": "Dataset", "hasTitle": [{"mainTitle": "D"}]}, {"@type": "Work", "hasTitle": [{"mainTitle": "K", "issueNumber": "9"}]}],
    "electronicLocator": [{"@type": "Resource", "uri": "u", "label": "L", "hasNote": [{"label": "free"}, {}]}],
}


def project(spark, *docs):
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string")
    return [json.loads(r[0]) for r in df.select(F.to_json(legacy.project(legacy.parse(F.col("j")), TERMS, F.lit("2024-07-08").cast("date")))).collect()]


def test_the_older_form(spark):
    got, bare, dated = project(spark, DOC, {"@id": "x", "instanceOf": {"genreForm": [{"@id": "v:/output/publication/book-review"}]}}, {"@id": "y", "publication": [{"@type": "Publication", "date": "2019-02-03"}, {"@type": "Publication"}, {"@type": "Publication", "date": "nonsense"}]})
    m = got["meta"]
    assert (m["controlNumber"], m["systemName"], m["created"], m["recordStatus"], m["marc:relatedIdentifier"]) == ("oai:a:1", "Sys", "210304", "marc:New", ["oai:b:2"])
    assert m["descriptionCreator"] == {"@id": "http://lib/org1", "@type": "Library", "sigel": "(Sys)org1"} and [x["@id"] for x in m["descriptionUpgrader"]] == ["http://lib/org2"]
    assert m["bibliography"] == [{"@type": "Bibliography", "sigel": "SYS"}] and got["issuanceType"] == "Monograph" and got["hasTitle"][0]["mainTitle"] == "T"
    assert got["publication"] == [{"@type": "PrimaryPublication", "year": "2024", "place": {"label": "Place"}, "agent": {"label": "Pub"}}, {"@type": "Other", "date": "1"}]
    assert [(i["@type"], i["value"], i.get("typeNote")) for i in got["identifiedBy"]] == [("Identifier", "10.1/a", "DOI"), ("Identifier", "urn:nbn:se:kth:diva-1", "urn"), ("Identifier", "10.1/a", "DOI"), ("ISBN", "9", None)]
    assert got["seriesMembership"][0] == {"@type": "SeriesMembership", "marc:seriesTracingPolicy": "0", "seriesStatement": ["S"], "seriesEnumeration": "3", "inSeries": {"@type": "Instance", "identifiedBy": [{"@type": "ISSN", "value": "1"}]}} and len(got["seriesMembership"]) == 2
    assert got["hasNote"] == [{"@type": "Note", "label": "n"}] and got["part"] == ["4:2, s. 5-6:9"]
    assert [(h["@type"], h["hasTitle"][0], h["marc:enumerationAndFirstPage"], h["provisionActivityStatement"]) for h in got["isPartOf"]] == [("Instance", {"mainTitle": "J"}, "4:2<5-6", "Place : Pub"), ("Instance", {"mainTitle": "K"}, "4:2<5-6:9", "Place : Pub")]
    assert got["electronicLocator"] == [{"@type": "Document", "uri": ["u"], "label": "L", "cataloguersNote": ["free"], "marc:linkText": ["L"]}]
    assert got["relatedTo"] == [{"@type": "Document", "uri": ["https://doi.org/10.1/a"]}, {"@type": "Document", "marc:linkText": ["Till lärosätets (kth) databas"], "cataloguersNote": ["lärosäteslänk"], "uri": ["http://urn/resolve?urn=urn:nbn:se:kth:diva-1"]}]
    assert bare["issuanceType"] == "ComponentPart" and bare["meta"]["created"] == "240708" and bare["meta"]["descriptionCreator"]["sigel"] == "(Sys)None" and "relatedTo" not in bare and "isPartOf" not in bare
    assert [p.get("year") for p in dated["publication"]] == ["2019", None, "2024"]


def test_subjects_and_contributions(spark):
    w = project(spark, DOC)[0]["instanceOf"]
    s = w["subject"]
    assert s[0] == {"@type": "Topic", "label": "lamps", "language": {"@type": "Language", "@id": "l:/eng", "code": "eng"}} and s[1] == {"@type": "Topic", "label": "plain"}
    assert [(x["label"], x["inScheme"]["code"]) for x in s[2:5]] == [("ref", "sys-contenttype"), ("kfu", "sys-publicationtype"), ("dok", "sys-publicationtype")]
    assert (s[5]["@id"], s[5]["inScheme"], s[5]["broader"]) == ("(Sys)10201", {"@id": "s:/uka/", "@type": "ConceptScheme", "code": "hsv//eng"}, {"prefLabel": "Computing", "broader": {"prefLabel": "Natural"}})
    assert [(x["@type"], x["prefLabel"]) for x in s[5]["termComponentList"]] == [("Topic", "NATURAL SCIENCES"), ("TopicSubdivision", "Computing"), ("TopicSubdivision", "CS")]
    assert s[6]["termComponentList"] == [{"@type": "Topic", "prefLabel": "NATURVETENSKAP"}] and "broader" not in s[6] and [c["@id"] for c in w["classification"]] == ["other"]
    c = w["contribution"]
    assert [x["@type"] for x in c] == ["Contribution", "PrimaryContribution", "Contribution", "Contribution"] and c[0]["role"] == [{"@id": "r:/edt", "@type": "Role", "code": "edt"}] and c[2]["role"] == [{"@id": "r:/aut"}]
    a = c[0]["agent"]
    assert (a["marc:affiliation"], a["marc:titlesAndOtherWordsAssociatedWithAName"], a["marc:uri"]) == ("Univ,Dept, X,Dept, X", "Dr", "(Sys:a)7")
    assert c[3] == {"@type": "Contribution", "agent": {"@type": "Organization", "isPartOf": {"@type": "Organization", "name": "Univ"}, "marc:subordinateUnit": ["Dept, X"]}, "role": [{"@id": "r:/org", "@type": "Role", "code": "org"}]}
