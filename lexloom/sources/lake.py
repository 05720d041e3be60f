"""The case-law lake: four Parquet layouts under one root.

Every layout has its court and year as partition folders, so a scope opens only its own files and an inventory
opens none. Harvested rows may also lie in plain folders, one Parquet file or more in each: a folder per collection
(``historical``) or per court (``recent``). Writers replace the partitions they have rows for and no others.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import CorpusNotSynced, InvalidRequest
from lexloom.operators.corpus import (
    ALL_COURTS,
    courts_present,
    uniform_view,
    years_per_court,
)
from lexloom.operators.courts import resolve_scope
from lexloom.operators.ranking import index_is_stale, read_index
from lexloom.operators.search import find_by_citation, search
from lexloom.rules.courts import SUPREME_COURT
from lexloom.sources import schemas
from lexloom.sources.files import any_file, folders, read_binary

#: Folder, partition columns from the outermost, columns of the rows.
_LAYOUTS = {
    "sc": ("sc/metadata", ["year"], schemas.SUPREME_COURT),
    "hc": ("hc/metadata", ["year", "court", "bench"], schemas.HIGH_COURT),
    "historical": ("historical", ["collection", "court", "year"], schemas.HARVESTED),
    "recent": ("recent", ["court", "year"], schemas.HARVESTED),
}
_HARVESTED = ("historical", "recent")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_INVENTORY = "court_code string, year string"


class CaseLawLake:
    """Metadata of judgments, and PDFs where they have been fetched."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _base(self, name: str) -> str:
        return f"{self.root}/{_LAYOUTS[name][0]}"

    def _partitioned(self, name: str) -> bool:
        first = _LAYOUTS[name][1][0]
        return any_file(self.spark, f"{self._base(name)}/{first}=*")

    def _plain(self, name: str) -> list[str]:
        """Folders of harvested rows without partition names."""
        if name not in _HARVESTED:
            return []
        return [path for path in folders(self.spark, f"{self._base(name)}/*") if "=" not in path.rsplit("/", 1)[-1]]

    def has(self, name: str) -> bool:
        """Whether a layout has any folder of rows."""
        return self._partitioned(name) or bool(self._plain(name))

    def source(self, name: str, scope: str = ALL_COURTS) -> DataFrame:
        """Raw rows of one layout; of the plain folders per court only that of the ``scope``.

        The schema is given, so no file is opened to infer it, columns are taken by name, and a column that
        a file lacks is NULL. A filter on a partition column chooses folders.
        """
        _, by, schema = _LAYOUTS[name]
        columns, found = _columns(schema), []
        if self._partitioned(name):
            extra = "".join(f", {c} string" for c in by if c not in columns)
            reader = self.spark.read.schema(schema + extra).option("basePath", self._base(name))
            found.append(reader.option("pathGlobFilter", "*.parquet").parquet(f"{self._base(name)}/{by[0]}=*"))
        plain = self._plain(name)
        if name == "recent" and scope != ALL_COURTS:
            plain = [path for path in plain if path.rsplit("/", 1)[-1] == scope]
        if plain:
            found.append(self.spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*plain))
        if not found:
            return self.spark.createDataFrame([], schema)
        return reduce(lambda a, b: a.unionByName(b), [df.select(*columns) for df in found])

    def sources(self, scope: str = ALL_COURTS) -> dict[str, DataFrame]:
        """Every layout that exists."""
        return {name: self.source(name, scope) for name in _LAYOUTS if self.has(name)}

    def corpus(self, court: str | None = None) -> DataFrame:
        """Uniform rows for one court or for all."""
        scope = resolve_scope(court)
        return uniform_view(self.sources(scope), scope)

    def search(self, query: str, court: str | None = None, **options) -> DataFrame:
        """One page of matching judgments, newest first."""
        return search(self.corpus(court), query, **options)

    def ranked_search(
        self, query: str, index_folder: str | None = None, court: str | None = None, **options
    ) -> DataFrame:
        """One page by BM25: from the stored index if it is there and fresh, else by a scan.

        Either way statistics are those of all courts, so the order does not depend on the index.
        """
        from lexloom.plans import research

        if index_folder and any_file(self.spark, f"{index_folder}/stats"):
            index = read_index(self.spark, index_folder)
            if not index_is_stale(self._files(), index.stats).first().stale:
                return research.indexed_search(self.corpus(court), index, query, **options)
        scope = resolve_scope(court)
        return research.ranked_search(
            self.corpus(), query, court_code=None if scope == ALL_COURTS else scope, **options
        )

    def _files(self) -> DataFrame:
        paths = [self._base(name) for name in _LAYOUTS if self.has(name)]
        listed = [read_binary(self.spark, path, "*.parquet").select("_metadata") for path in paths]
        return reduce(lambda a, b: a.union(b), listed)

    def find_by_citation(self, citation: str, limit: int = 5) -> DataFrame:
        """Supreme Court judgments that carry a citation."""
        if not self.has("sc"):
            raise CorpusNotSynced("Supreme Court metadata is not synced")
        rows = uniform_view({"sc": self.source("sc")}, SUPREME_COURT)
        return find_by_citation(rows, citation, limit)

    def partitions(self, name: str) -> list[dict[str, str | None]]:
        """Values of the partition folders of a layout, by listing them; no file is opened."""
        by = _LAYOUTS[name][1]
        pattern = "/".join(f"{c}=*" for c in by)
        rows = []
        for path in folders(self.spark, f"{self._base(name)}/{pattern}"):
            values = [part.split("=", 1)[1] for part in path.split("/")[-len(by) :]]
            rows.append(dict(zip(by, (None if v == _NO_VALUE else unquote(v) for v in values))))
        return rows

    def held(self, name: str) -> DataFrame:
        """(court_code, year) of a layout: from folder names, and from two columns of the plain folders."""
        rows = {(SUPREME_COURT if name == "sc" else p["court"], p["year"]) for p in self.partitions(name)}
        listed = self.spark.createDataFrame(sorted(rows, key=str), _INVENTORY)
        plain = self._plain(name)
        if not plain:
            return listed
        read = self.spark.read.schema(_LAYOUTS[name][2]).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*plain)
        return listed.union(read.select("court", F.col("year").cast("string"))).distinct()

    def inventory(self) -> DataFrame:
        """Years held per court. Where rows are partitioned only folder names are read."""
        found = [self.held(name) for name in _LAYOUTS if self.has(name)]
        if not found:
            raise CorpusNotSynced("no local case-law metadata")
        return years_per_court(reduce(lambda a, b: a.union(b), found))

    def harvested_courts(self, name: str) -> DataFrame:
        """Courts that have historical or recent rows."""
        if not self.has(name):
            raise CorpusNotSynced(f"no {name} corpus")
        return courts_present(self.held(name))

    def status(self, index_folder: str | None = None) -> DataFrame:
        """One row per court: judgments, first and last year; and whether the index is stale.

        Rows are counted from file footers: no column but partition folders' is needed.
        """
        stale = F.lit(None).cast("boolean")
        if index_folder and any_file(self.spark, f"{index_folder}/stats"):
            stats = self.spark.read.parquet(f"{index_folder}/stats")
            stale = index_is_stale(self._files(), stats).scalar()
        return self.corpus().groupBy("court_code").agg(
            F.count("*").alias("judgments"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
        ).withColumn("index_is_stale", stale)

    def pdf_count(self) -> DataFrame:
        """One row: number of judgment PDFs held locally."""
        if not any_file(self.spark, f"{self.root}/pdf/*"):
            raise CorpusNotSynced("no judgment PDFs are held locally")
        return read_binary(self.spark, f"{self.root}/pdf", "*.pdf").agg(
            F.count("path").alias("pdf_count")
        )


def write_layout(rows: DataFrame, root: str, name: str) -> None:
    """Write raw rows of one layout, replacing the partitions that they have rows for and no others.

    Rows are dealt out by partition; one that is large is split, and small ones share a task. Rows with a null
    partition value share a folder of their own.
    """
    if name not in _LAYOUTS:
        raise InvalidRequest(f"unknown layout {name!r}: one of {sorted(_LAYOUTS)}")
    base, by, schema = _LAYOUTS[name]
    columns = _columns(schema)
    whole = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in dict.fromkeys([*columns, *by])]
    (
        rows.select(*whole).hint("rebalance", *by)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        .parquet(f"{root.rstrip('/')}/{base}")
    )


def write_historical(rows: DataFrame, root: str, name: str) -> None:
    """Write harvested rows as (part of) one historical collection."""
    write_layout(rows.withColumn("collection", F.lit(name)), root, "historical")


def write_recent(rows: DataFrame, root: str) -> None:
    """Write recent rows by court and year, in a single job."""
    write_layout(rows, root, "recent")


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
