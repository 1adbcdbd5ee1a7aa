"""Model registry: raw tables -> staging views -> marts, resolved by name.

``Warehouse.ref(name)`` plays the role of a model reference: it builds (once) the
DataFrame of a staging relation or mart from its dependencies. Everything stays
lazy, so one action compiles the whole chain into one Catalyst plan and naming a model
runs nothing; ``materialize`` writes chosen marts into new version folders and swaps their
references to the written tables, which also cuts the lineage for downstream consumers.

With a ``database``, loads and builds are also tables that any session of the catalog can
name (see ``revlens.sources.tables``), staging relations are permanent views over them, and
facts and the account dimension may be bucketed by account for joins without a shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlens.config import Horizon
from revlens.plans.staging import STAGING, stage, staging_sql
from revlens.session import scratch_dir
from revlens.sources.tables import Layout, TableCatalog

RawSource = Mapping[str, DataFrame] | Callable[[], Mapping[str, DataFrame]]
MartFn = Callable[["Warehouse"], DataFrame]
MARTS: dict[str, MartFn] = {}

# Physical layout of materialized marts (month partitioning lets latest-month queries prune).
MART_PARTITIONING: dict[str, list[str]] = {"fct_revenue_monthly": ["revenue_month"]}

# Marts that are joined with the account dimension, and the dimension: bucketed alike, they
# join without a shuffle.
BY_ACCOUNT = ("dim_account", "fct_revenue_monthly", "fct_activation", "fct_support")


def mart(name: str) -> Callable[[MartFn], MartFn]:
    def register(fn: MartFn) -> MartFn:
        MARTS[name] = fn
        return fn

    return register


class Warehouse:
    """``raw`` is a mapping of raw tables, or a function that opens them anew at each load."""

    def __init__(self, spark: SparkSession, raw: RawSource, horizon: Horizon | Callable[[], Horizon]):
        self.spark = spark
        self._source = raw
        self._raw = raw() if callable(raw) else raw
        self._horizon_of = horizon
        self._horizon: Horizon | None = None
        self._models: dict[str, DataFrame] = {}  # built lazily in this session
        self._written: dict[str, DataFrame] = {}  # materialized
        self._folders: dict[str, str] = {}  # of the materialized
        self._building = False

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, horizon: Horizon | None = None) -> "Warehouse":
        from revlens.sources.testdata import TestdataRaw

        opened: list[TestdataRaw] = []  # the last one gives both the tables and their calendar

        def open_tables():
            opened.append(TestdataRaw(spark, sf_dir, horizon))
            return opened[-1].all()

        return cls(spark, open_tables, lambda: opened[-1].horizon)

    @classmethod
    def from_files(cls, spark: SparkSession, directory: str, horizon: Horizon, fmt: str = "csv") -> "Warehouse":
        from revlens.sources.files import read_raw

        return cls(spark, lambda: read_raw(spark, directory, fmt=fmt), horizon)

    @classmethod
    def from_catalog(cls, spark: SparkSession, folder: str, database: str, horizon: Horizon) -> "Warehouse":
        """The tables that builds with this folder and database have published (raw ones below ``raw``),
        registered again where the session's catalog does not know them, e.g. in a new application."""
        loaded, built = TableCatalog(spark, database, f"{folder.rstrip('/')}/raw"), TableCatalog(spark, database, folder)
        wh = cls(spark, {name: loaded.table(name) for name in loaded.attach()}, horizon)
        for name in built.attach([n for n in MART_ORDER]):
            wh._written[name] = built.table(name)
            wh._folders[name] = built.folder_of(name)
        wh.publish_views(loaded)
        return wh

    @property
    def horizon(self) -> Horizon:
        if self._horizon is None:
            self._horizon = self._horizon_of() if callable(self._horizon_of) else self._horizon_of
        return self._horizon

    def raw(self, name: str) -> DataFrame:
        return self._raw[name]

    @property
    def raw_tables(self) -> Mapping[str, DataFrame]:
        return self._raw

    def ref(self, name: str) -> DataFrame:
        if name in self._written:
            return self._written[name]
        if name not in self._models:
            if name in STAGING:
                self._models[name] = stage(name, self._raw[STAGING[name][0]])
            else:
                import revlens.plans.marts  # noqa: F401  (registers the marts)

                if name not in MARTS:
                    raise KeyError(f"unknown model {name!r}")
                self._models[name] = MARTS[name](self)
        return self._models[name]

    @property
    def step(self) -> Callable[[DataFrame, str], DataFrame] | None:
        """Stores an intermediate frame of a mart that is being written; None while models are only named."""
        return self._store_step if self._building else None

    def _store_step(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def latest(self, name: str, column: str) -> Column:
        """The latest value of a date column: read off the partition folders of a mart that is
        written by that column, else a scalar subquery."""
        from revlens.sources.files import partition_values

        if name in self._folders and column in MART_PARTITIONING.get(name, []):
            values = partition_values(self.spark, self._folders[name], column)
            return F.lit(dt.date.fromisoformat(max(values)) if values else None).cast("date")
        return self.ref(name).agg(F.max(column)).scalar()

    def register_views(self, names: Iterable[str] | None = None, prefix: str = "") -> list[str]:
        """Expose staging relations and marts as temporary views (for ad-hoc SQL)."""
        import revlens.plans.marts  # noqa: F401

        registered = []
        for name in names or [*STAGING, *MARTS]:
            self.ref(name).createOrReplaceTempView(prefix + name)
            registered.append(prefix + name)
        return registered

    def publish_views(self, catalog: TableCatalog) -> list[str]:
        """Staging relations as permanent views, i.e. SQL text over the loaded tables' names."""
        made = []
        for name, (raw, _) in STAGING.items():
            if self.spark.catalog.tableExists(catalog.name(raw)):
                catalog.create_view(name, staging_sql(name, catalog.table(raw).schema, catalog.name(raw)))
                made.append(name)
        return made

    def sql(self, text: str, **args) -> DataFrame:
        """Ad-hoc query over the registered views and tables; values are bound (``:name``), not pasted."""
        return self.spark.sql(text, args=args or None)

    def load_raw(self, base_path: str, names: Iterable[str] | None = None, database: str | None = None,
                 counts: dict[str, int] | None = None, keep: int | None = None) -> dict[str, str]:
        """Replace-on-load: write the raw tables (Parquet) and read them back.

        The source is opened anew, so a second load sees rows that came since. Each table
        gets a new version folder and becomes current when it is complete; what was
        current stays readable meanwhile. Staging views and marts built afterwards scan
        the loaded tables instead of re-deriving each raw shape per consumer. The folder
        can be reopened later with ``Warehouse.from_files(..., fmt="parquet")``, or, with a
        ``database``, by the names of its tables. ``counts`` receives the rows of each table,
        observed while they were written; ``keep`` removes all but the newest versions.
        """
        from revlens.sources.files import drop_versions, raw_path, write_version

        catalog = TableCatalog(self.spark, database, base_path) if database else None
        source = self._source() if callable(self._source) else self._source
        self._horizon = None
        loaded = {}
        for name in names or list(source):
            df, seen = source[name], None
            if counts is not None:
                seen = Observation(f"load-{name}")
                df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            loaded[name] = catalog.publish(df, name) if catalog else write_version(df, raw_path(base_path, name, "parquet"))
            if seen is not None:
                counts[name] = seen.get["rows"]
        self._raw = {**dict(source.items()), **{n: self.spark.read.schema(source[n].schema).parquet(p) for n, p in loaded.items()}}
        self._models, self._written, self._folders = {}, {}, {}
        for name in loaded if keep is not None else ():
            _ = catalog.drop_old(name, keep) if catalog else drop_versions(self.spark, raw_path(base_path, name, "parquet"), keep)
        return loaded

    def materialize(self, base_path: str, names: Iterable[str], database: str | None = None, buckets: int = 0,
                    keep: int | None = None) -> dict[str, str]:
        """Rebuild marts (in the given dependency order) and read them back.

        Each is computed from its model again, from the raw tables and from marts that
        are written already, into a new version folder that then becomes current. A
        rebuild of the same folder never reads what it replaces. With a ``database`` they
        become tables with statistics, those of ``BY_ACCOUNT`` in ``buckets`` (if any).
        ``keep`` removes all but the newest versions once a mart is written.
        """
        from revlens.sources.files import drop_versions, write_version

        catalog = TableCatalog(self.spark, database, base_path) if database else None
        names = list(names)
        for name in names:
            self._written.pop(name, None)
            self._folders.pop(name, None)
        self._models, self._building = {}, True
        written = {}
        try:
            for name in names:
                folder = f"{base_path.rstrip('/')}/{name}"
                if catalog:
                    bucketed = buckets and name in BY_ACCOUNT
                    layout = Layout(tuple(MART_PARTITIONING.get(name, ())), ("account_id",) if bucketed else (), buckets if bucketed else 0)
                    path = catalog.publish(self.ref(name), name, layout)
                    self._written[name] = catalog.table(name)
                else:
                    df = self.ref(name)
                    path = write_version(df, folder, MART_PARTITIONING.get(name))
                    self._written[name] = self.spark.read.schema(df.schema).parquet(path)
                self._folders[name] = path
                self._models.pop(name, None)
                written[name] = path
                if keep is not None:
                    _ = catalog.drop_old(name, keep) if catalog else drop_versions(self.spark, folder, keep)
        finally:
            self._building = False
            self._models = {}
        return written


# Dependency order of the marts (a valid build order).
MART_ORDER = [
    "dim_date", "dim_account", "fct_pipeline", "fct_retention", "fct_cac_ltv",
    "fct_revenue_monthly", "fct_activation", "fct_support", "fct_anomalies",
]
