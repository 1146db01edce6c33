"""A data source for OAI-PMH: ``spark.read.format("oai").option("url", ...).option("set", ...)``.

One partition for each set, as tokens can be followed only one after another.
A page that fails is asked for again, so a lost executor costs a set's read.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The protocol's namespace and the answers that are worth another try.
NS = "{http://www.openarchives.org/OAI/2.0/}"
RETRY = [429, 500, 502, 503, 504]


class HarvestError(RuntimeError):
    """The server's error, by its code."""


class SetPartition(InputPartition):
    def __init__(self, name: str | None):
        self.name = name


class OaiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[SetPartition]:
        return [SetPartition(x or None) for x in self.o.get("set", "").split(",")]

    def fetch(self, query: dict[str, str]) -> bytes:
        tries, wait = int(self.o.get("retries", "3")), float(self.o.get("wait", "1"))
        request = urllib.request.Request(f"{self.o['url']}?{urllib.parse.urlencode(query)}", headers={"User-Agent": self.o.get("useragent", "pubspark")})
        for k in range(tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=float(self.o.get("timeout", "60"))) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code not in RETRY or k == tries:
                    raise HarvestError(f"HTTP {e.code}") from e
                time.sleep(float(e.headers.get("Retry-After") or wait * 2**k))
        raise AssertionError

    def read(self, partition: SetPartition) -> Iterator[tuple]:
        prefix = {"verb": self.o.get("verb", "ListRecords")}
        query = prefix | {"metadataPrefix": self.o.get("metadataprefix", "mods")}
        query |= {k: v for k, v in {"set": partition.name, "from": self.o.get("from"), "until": self.o.get("until")}.items() if v}
        while query:
            page = ElementTree.fromstring(self.fetch(query))
            if (error := page.find(f"{NS}error")) is not None:
                if error.get("code") == "noRecordsMatch":
                    return
                raise HarvestError(f"{error.get('code')}: {error.text or ''}")
            for header in page.iter(f"{NS}header"):
                yield self.row(page, header, partition.name)
            token = next((t.text for t in page.iter(f"{NS}resumptionToken") if t.text and t.text.strip()), None)
            query = prefix | {"resumptionToken": token.strip()} if token else {}

    def row(self, page: ElementTree.Element, header: ElementTree.Element, name: str | None) -> tuple:
        if not hasattr(self, "_page") or self._page is not page:
            self._page, self._of = page, {id(r.find(f"{NS}header")): r for r in page.iter(f"{NS}record")}
        record = self._of.get(id(header))
        data = record.find(f"{NS}metadata") if record is not None else None
        xml = ElementTree.tostring(data[0], encoding="unicode") if data is not None and len(data) else None
        return header.findtext(f"{NS}identifier"), header.get("status") == "deleted", header.findtext(f"{NS}datestamp"), name, xml


class OaiDataSource(DataSource):
    """Records or headers of a repository: oai_id, deleted, datestamp, source_subset, xml (null for deleted ones and headers)."""

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return "oai_id string, deleted boolean, datestamp string, source_subset string, xml string"

    def reader(self, schema: object) -> OaiReader:
        return OaiReader(dict(self.options))
