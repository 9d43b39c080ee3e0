"""The functions that users of the HTTP interface know, over stored tables; every one returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import text as X
from .operators import candidates, relations, scenarios, search


class Catalog:
    """Tables of one database folder: base tables, the six aggregates, ``task1_entities`` and job updates.

    With a ``path``, what changes is written there as a new version, and a version counts once all of it is written; the
    tables are read again from it, so lineages stay short.  Without one, tables live as long as the object.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], path: str | None = None):
        self.spark, self.tables, self.path = spark, dict(tables), path
        missing = [n for n in relations.AGGREGATES if n not in self.tables]
        if missing and "bids" in self.tables:
            made = relations.refresh_aggregates(self.tables)
            self.tables |= {n: made[n] for n in missing}

    @classmethod
    def open(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Catalog:
        """The last version below a path (none: an empty catalog), or plain table folders by name."""
        if names is not None:
            return cls(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names})
        last = max(sinks.versions(spark, path), default=0)
        if not last:
            return cls(spark, {}, path)
        return cls(spark, {n: spark.read.parquet(f"{path}/v{last}/{n}") for n in sinks.folders(spark, f"{path}/v{last}")}, path)

    def _store(self, tables: dict[str, DataFrame]) -> None:
        """Take tables as they are now; with a path, as its next version.  Aggregates are ordered by their first key, so
        that a scenario of one buyer or supplier reads few of their files."""
        if self.path is None:
            self.tables = tables
            return
        ordered = {n: rows.repartitionByRange(rows.columns[0]).sortWithinPartitions(rows.columns[0]) if n in relations.AGGREGATES else rows for n, rows in tables.items()}
        sinks.write_version(self.spark, ordered, self.path, 1 + max(sinks.versions(self.spark, self.path), default=0))
        self.tables = type(self).open(self.spark, self.path).tables

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def status(self) -> DataFrame:
        return relations.counts({n: self.tables[n] for n in ("projects", "packages", "organizations", "bids", "products") if n in self.tables})

    def import_task1(self, notices: DataFrame) -> DataFrame:
        """Items of notices in place of what is stored of those notices."""
        rows = search.imported(notices)
        old = self.tables.get("task1_entities")
        self._store(self.tables | {"task1_entities": rows if old is None else relations.upsert(old, rows, "notice_id")})
        return self.tables["task1_entities"]

    def items(self, page: int = 1, page_size: int = 20, **facets: str) -> tuple[DataFrame, DataFrame]:
        if not 1 <= page_size <= 100:
            raise ValueError("page_size must be 1 to 100")
        return search.page(self["task1_entities"], page, page_size, **facets)

    def item(self, entity_id: str) -> DataFrame:
        return search.entity(self["task1_entities"], entity_id)

    def export_csv(self, path: str, **facets: str) -> int:
        return sinks.write_csv_file(search.export(self["task1_entities"], **facets), path)

    def export_xlsx(self, path: str, **facets: str) -> int:
        return sinks.write_xlsx_file(search.export(self["task1_entities"], **facets), path)

    def ingest_projects(self, trees: DataFrame) -> DataFrame:
        """Store project trees in place of what is stored of their notices; returns the notices set aside."""
        made, quarantine = relations.ingest(trees)
        whole = relations.merged(self.tables, made)
        self._store(self.tables | whole | relations.refresh_aggregates(whole))
        return quarantine

    def projects(self, query: str = "", limit: int = 50) -> DataFrame:
        return scenarios.projects(self["projects"], query, limit)

    def extract_candidate(self, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        return candidates.metadata(blocks), candidates.bids(blocks)

    def organizations(self, query: str = "", limit: int = 50) -> DataFrame:
        norm = self.spark.range(1).select(X.normalize_org_name(F.lit(query))).first()[0]
        return scenarios.organizations(self["organizations"], query, norm, limit)

    def aliases_review(self, limit: int = 100) -> DataFrame:
        return scenarios.alias_review_queue(self["alias_review_queue"], self["organizations"], limit)

    def win_suppliers(self, unit_id) -> DataFrame:
        return scenarios.unit_win_suppliers(self["unit_win_stats"], self["organizations"], unit_id)

    def top_bidders(self, unit_id, top: int = 5) -> DataFrame:
        return scenarios.unit_top_bidders(self["unit_bidder_stats"], self["organizations"], unit_id, top)

    def co_bid_pairs(self, unit_id) -> DataFrame:
        return scenarios.unit_cobid_pairs(self["unit_cobid_pairs"], self["organizations"], unit_id)

    def co_bidders(self, supplier_id, top: int = 5) -> DataFrame:
        return scenarios.supplier_cobidders(self["supplier_cobid"], self["organizations"], supplier_id, top)

    def common_units(self, ids: str | list) -> DataFrame:
        return scenarios.common_units(self.tables, self._ids(ids))

    def joint_projects(self, ids: str | list) -> DataFrame:
        return scenarios.joint_projects(self.tables, self._ids(ids))

    def subgraph(self, project_id) -> tuple[DataFrame, DataFrame]:
        return scenarios.project_subgraph(self.tables, project_id)

    def job(self, job_id: str) -> DataFrame:
        return search.latest_jobs(self["job_updates"].where(F.col("job_id") == job_id))

    def recent_jobs(self, limit: int = 20) -> DataFrame:
        return search.recent_jobs(search.latest_jobs(self["job_updates"]), limit)

    @staticmethod
    def _ids(ids: str | list) -> list:
        """X-29."""
        return [x.strip() for x in ids.split(",") if x.strip()] if isinstance(ids, str) else list(ids)
