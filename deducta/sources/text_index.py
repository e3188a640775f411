"""Providers of files and the text indexes over them, as relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import computed
from ..functions.computed import Computed
from .scratch import staged


@dataclass(frozen=True)
class Provider:
    """files: a DataFrame with repository, path, text (and whatever else)."""

    key: str
    name: str
    files: DataFrame | None
    capabilities: tuple[str, ...] = ("files", "text")

    @property
    def available(self) -> bool:
        return self.files is not None


@dataclass
class Index:
    """An index's metadata; units and files are there once it is built."""

    key: str
    repository: str
    revision: str
    provider: str
    status: str = "new"
    version: int = 0
    error: str = ""
    units: DataFrame | None = None
    files: DataFrame | None = None


@dataclass
class Sources:
    spark: SparkSession
    providers: dict[str, Provider] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def register(self, provider: Provider) -> Provider:
        self.providers[provider.key] = provider
        return provider

    def build(self, key: str, repository: str, revision: str, provider: str) -> Index:
        """(Re)builds an index of a repository's files. A failure is kept as its error; an older build stays readable."""
        index = self.indexes.setdefault(key, Index(key, repository, revision, provider))
        index.repository, index.revision, index.provider = repository, revision, provider
        source = self.providers.get(provider)
        if source is None or not source.available:
            index.status, index.error = "failed", f"provider {provider} isn't available"
            return index
        own = source.files.filter(F.col("repository") == repository)
        units = computed.text_units(own).withColumns({"kind": F.regexp_extract(F.col("path").cast("string"), r"\.([^./]+)$", 1), "model": F.lit("text-unit")})
        unit = F.concat_ws(":", "repository", F.col("path").cast("string"), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")), F.col("ordinal").cast("string"))
        index.units = staged(units.select(unit.alias("unit"), "repository", "ordinal", "kind", "title", "path", "start_line", "end_line", "model", "text"), "units")
        index.files = own.select("repository", "path", F.octet_length("text").alias("bytes"), F.size(computed._lines(F.col("text"))).alias("lines"), F.sha2("text", 256).alias("sha256"))
        index.status, index.error, index.version = "complete", "", index.version + 1
        return index

    def views(self) -> dict[str, DataFrame]:
        frame = self.spark.createDataFrame
        p, i = list(self.providers.values()), list(self.indexes.values())
        each = lambda name, kind, of: frame([(x.key, of(x)) for x in i], f"index string, {name} {kind}")
        return {
            "Provider": frame([(x.key,) for x in p], "provider string"),
            "ProviderName": frame([(x.key, x.name) for x in p], "provider string, name string"),
            "ProviderCapability": frame([(x.key, c) for x in p for c in x.capabilities], "provider string, capability string"),
            "ProviderAvailable": frame([(x.key,) for x in p if x.available], "provider string"),
            "SourceIndex": frame([(x.key,) for x in i], "index string"),
            "IndexRepository": each("repository", "string", lambda x: x.repository),
            "IndexRevision": each("revision", "string", lambda x: x.revision),
            "IndexProvider": each("provider", "string", lambda x: x.provider),
            "IndexStatus": each("status", "string", lambda x: x.status),
            "IndexVersion": each("version", "long", lambda x: x.version),
            "IndexBuildError": frame([(x.key, x.error) for x in i if x.error], "index string, error string"),
        }

    def relations(self) -> list[Computed]:
        """IndexedTextUnit, IndexedFile, IndexedTextSearch, RepositoryEntry and FileText; indexes that aren't complete are empty."""

        def of(index: str, what: str) -> DataFrame | None:
            x = self.indexes.get(index)
            return None if x is None else getattr(x, what)

        def rows(given: dict, what: str, columns: tuple[str, ...]) -> DataFrame:
            df = of(given[0], what)
            if df is None:
                return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in ("index", *columns)))
            return df.select(F.lit(given[0]).alias("index"), *columns)

        unit = ("unit", "repository", "ordinal", "kind", "title", "path", "start_line", "end_line")
        file = ("repository", "path", "bytes", "lines", "sha256")
        hit = ("unit", "score", "path", "match_line", "kind", "title", "snippet")

        def search(given: dict) -> DataFrame:
            units = of(given[0], "units")
            if units is None:
                return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in ("index", "query", "limit", "scope", *hit)))
            found = computed.text_search(units, str(given[1]), int(given[2]), str(given.get(3, "all")))
            return found.select(F.lit(given[0]).alias("index"), F.lit(given[1]).alias("query"), F.lit(given[2]).alias("limit"), F.lit(given.get(3, "all")).alias("scope"), *hit)

        def files(given: dict, *columns: str) -> DataFrame:
            p = self.providers.get(given[0])
            if p is None or not p.available:
                return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in ("provider", "repository", *columns)))
            return p.files.filter(F.col("repository") == given[1]).withColumn("bytes", F.octet_length("text")).select(F.lit(given[0]).alias("provider"), "repository", *columns)

        return [
            Computed("IndexedTextUnit", ("index", *unit), (0,), lambda g: rows(g, "units", unit)),
            Computed("IndexedFile", ("index", *file), (0,), lambda g: rows(g, "files", file)),
            Computed("IndexedTextSearch", ("index", "query", "limit", "scope", *hit), (0, 1, 2), search),
            Computed("RepositoryEntry", ("provider", "repository", "path", "bytes"), (0, 1), lambda g: files(g, "path", "bytes")),
            Computed("FileText", ("provider", "repository", "path", "text"), (0, 1), lambda g: files(g, "path", "text")),
        ]
