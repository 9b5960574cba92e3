"""Paged provider feeds as a data source, and the helpers around a request."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Provider keys, and the names by which they are known.
PROVIDERS = ("impact", "cj", "awin", "rakuten", "shareasale", "custom_rest")
ALIASES = {
    "impact.com": "impact", "impact radius": "impact", "cj affiliate": "cj", "commission junction": "cj", "awin.com": "awin",
    "rakuten advertising": "rakuten", "rakuten linkshare": "rakuten", "share a sale": "shareasale", "share-a-sale": "shareasale",
}
# Names under which a URL may ask for a credential.
VARIABLES = {
    "username": ("username", "user", "login", "accountsid", "accountid", "account", "sid", "merchantid", "siteid", "publisherid", "affiliateid"),
    "password": ("password", "pass", "secret"),
    "apikey": ("apikey", "key", "apitoken"),
    "accesstoken": ("accesstoken", "token", "bearertoken"),
    "clientid": ("clientid", "applicationid", "appid"),
    "clientsecret": ("clientsecret", "applicationsecret", "appsecret"),
    "apiversion": ("apiversion", "version"),
}
# Retries.
RETRYABLE = frozenset({429, 500, 502, 503, 504})
LONGEST_WAIT_MS = 30_000


def provider_key(*names: Column) -> Column:
    """The provider that the first known name means; custom_rest if none is known."""
    known = {**{p: p for p in PROVIDERS}, **ALIASES}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(*[F.try_element_at(table, F.lower(F.trim(n))) for n in names], F.lit("custom_rest"))


def retry_wait(attempt: int, attempts: int, status: int | None = None, network_error: bool = False, retry_after_ms: int = 0, base_ms: int = 1000) -> int | None:
    """Milliseconds to wait before the next attempt (without jitter), or None to give up."""
    if attempt + 1 >= attempts or not (network_error or status in RETRYABLE):
        return None
    return max(retry_after_ms, min(base_ms * 2**attempt, LONGEST_WAIT_MS))


def fill_placeholders(template: str, credentials: dict[str, str]) -> tuple[str, list[str]]:
    """(text, unresolved names): {Name} in any case and punctuation, values URL-encoded."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    values = {alias: credentials[name] for name, aliases in VARIABLES.items() if credentials.get(name) for alias in aliases}
    missing: list[str] = []

    def fill(m: re.Match) -> str:
        if plain(m[1]) in values:
            return quote(values[plain(m[1])], safe="!'()*~")
        missing.append(m[1])
        return m[0]

    return re.sub(r"\{([A-Za-z0-9_.\- ]+)\}", fill, template), missing


def config_errors(enabled: Column, base_url: Column, timeout_ms: Column, retries: Column, auth: Column, has: Callable[[str], Column]) -> Column:
    """What is wrong with an integration, as an array; has(name) tells whether a credential is there."""
    from dealforge.functions.offers import is_url

    lacks = (
        F.when((auth == "api_key") & ~has("apikey"), "API key credential is missing")
        .when((auth == "bearer") & ~has("accesstoken"), "Bearer access token is missing")
        .when((auth == "basic") & ~has("username") & ~has("password"), "Basic auth username/password is missing")
        .when((auth == "oauth2") & ~has("accesstoken") & ~(has("clientid") & has("clientsecret")), "OAuth2 requires either an access token or client credentials")
        .when(~auth.isin("api_key", "bearer", "basic", "oauth2", "custom_headers"), "Unknown authentication type")
    )
    no_url = F.coalesce(base_url, F.lit("")) == ""
    rules = [
        F.when(~enabled, "Integration is disabled"),
        F.when(no_url, "Base URL is required").when(~is_url(base_url), "Base URL is invalid"),
        F.when(~F.coalesce(timeout_ms.between(1000, 600_000), F.lit(False)), "Timeout must be between 1000 and 600000 ms"),
        F.when(~retries.between(0, 20), "Retry attempts must be between 0 and 20"),
        lacks,
    ]
    return F.array_compact(F.array(*rules))


def unwrap(bodies: DataFrame, body: str, *keys: str) -> DataFrame:
    """S3: one row per record (JSON text) of each body: an array, a named array, or the first array of an object.

    What is no object is no record (F16). A body is parsed a fixed number of times,
    whatever its keys: its values' types come from VARIANT, so that a text that looks
    like an array is none, and its records keep the text they came in. Where a nested
    object names a key twice there is no VARIANT, and the texts have to tell.
    """
    text = F.col(body)
    parsed = bodies.withColumn("__types", F.from_json(text, "map<string,variant>")).withColumn("__texts", F.from_json(text, "map<string,string>"))
    of_object = F.filter(F.map_entries("__types"), lambda e: F.schema_of_variant(e["value"]).startswith("ARRAY"))
    like_arrays = F.filter(F.map_entries("__texts"), lambda e: F.coalesce(F.ltrim(e["value"]).startswith("["), F.lit(False)))
    names = F.transform(F.when(F.size("__types") == F.size("__texts"), of_object), lambda e: e["key"])
    names = F.coalesce(names, F.transform(like_arrays, lambda e: e["key"]))
    named = [F.when(F.array_contains(names, k), F.lit(k)) for k in keys]
    array = "array<string>"
    records = F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, array)), F.from_json(F.try_element_at("__texts", F.coalesce(*named, F.get(names, 0))), array))
    out = parsed.select(*bodies.columns, F.explode(records).alias("record"))
    return out.filter(F.ltrim("record").startswith("{"))


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    """Pages of a provider, one partition a run of pages; a run ends at an empty or short page."""

    def __init__(self, options: dict[str, str]):
        self.fetch_name = options.get("fetch", "")
        self.first, self.pages = int(options.get("startpage", "1")), int(options.get("maxpages", "2"))
        self.size, self.each = int(options.get("pagesize", "100")), int(options.get("pagesperpartition", "1"))
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(n) for n in range(self.first, self.first + self.pages, self.each)]

    def read(self, partition: Page) -> Iterator[tuple]:
        import importlib

        module, _, name = self.fetch_name.rpartition(":")
        fetch = getattr(importlib.import_module(module), name)
        last = min(partition.number + self.each, self.first + self.pages)
        for number in range(partition.number, last):
            records = fetch(number, self.size, self.options)
            for place, record in enumerate(records):
                yield number, place, json.dumps(record)
            if len(records) < self.size:
                break


class ProviderSource(DataSource):
    """format("provider_pages") with options fetch="module:function", startPage, maxPages, pageSize.

    fetch(page, size, options) gives the records of a page. Pages are read in
    parallel, so that a short page in the middle ends only its own partition.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return "page int, place int, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProviderSource)
