"""Stored tables loaded from raw data, each on first use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import AMOUNT, money_sum
from ..operators.changes import EDITED, Change, dated
from ..schema import LOAD_ORDER, TABLES, load_levels
from ..sources.catalog import (
    create_tables,
    empty_rows,
    is_finished,
    is_loaded,
    overwrite_slices,
    read_rejects,
    read_slices,
    read_table,
    replace_table,
    stored_state,
    touched_slices,
    write_judged,
)
from . import reports
from .build import DATASETS, prepare_tables
from .load import judge_table
from .reports import GROUNDHOG_CATEGORY
from .views import VIEW_TABLES, create_catalog_views


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the session's checkpoint folder.

    A local session without the setting gets a temporary folder; a cluster must
    name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="retailmart-")


_PRICED = ("Sold", "OnSale", "Product")
_DAILY = f"StoreNumber bigint, CalendarDate date, amount {AMOUNT}"


class Warehouse(Mapping[str, DataFrame]):
    """The twelve stored tables by name.

    Asking for a table cleans, checks and stores it once, after its parents; later
    uses read the stored files. So a report runs only the loads it needs, and the
    work of a load is never repeated in a report. One job stores what a load accepts and
    what it rejects. ``buckets`` is the number of buckets of the large tables, by default
    ``spark.sql.shuffle.partitions``; at about one for each 128 MB of sales a bucket fits
    a task. ``slices`` is the number of parts of the tables that are edited row by row.

    ``location`` opens the tables that an earlier application left in that folder, as their
    newest versions are, edits, appended rows and rejects included; ``database`` those that
    the session's catalog still knows by that name. Only what is absent is created, and
    ``raw`` is read only for tables not loaded yet. One application at a time writes to a
    location.
    """

    def __init__(
        self,
        spark: SparkSession,
        raw: Mapping[str, DataFrame],
        order: Mapping[str, Sequence[str]] | None = None,
        location: str | None = None,
        buckets: int | None = None,
        database: str | None = None,
        slices: int = 8,
    ) -> None:
        name = database or f"retailmart_{uuid.uuid4().hex[:12]}"
        self.spark = spark
        self.database = name
        self.location = (location or f"{shared_folder(spark)}/{name}").rstrip("/")
        # Sale prices are checked against the stored products: one that did not
        # load fails the foreign key of its prices anyway.
        self._clean = prepare_tables(raw, order, prices=self)
        # Rows accepted and rejected by the loads and appends of this object.
        self.counts: dict[str, tuple[int, int]] = {}
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        create_tables(spark, name, self.location, buckets, slices)
        reopened = database is not None or location is not None
        self._loaded = {table for table in TABLES if reopened and is_loaded(spark, name, table)}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name not in self._loaded:
            self._load(name)
        return read_table(self.spark, self.database, name)

    def __iter__(self) -> Iterator[str]:
        return iter(LOAD_ORDER)

    def __len__(self) -> int:
        return len(LOAD_ORDER)

    def load_all(self) -> None:
        """Load what is missing; tables that do not need each other load side by side,
        so the short jobs of the small ones fill the gaps of the large ones."""
        for level in load_levels():
            missing = [name for name in level if name not in self._loaded]
            with ThreadPoolExecutor(max_workers=len(level)) as pool:
                list(pool.map(self._load, missing))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Store a new version of a table, as a change operator returned it."""
        self[name]
        replace_table(self.spark, self.database, self.location, name, rows)

    def edit(self, operator: Callable[..., Change], changes: DataFrame) -> DataFrame:
        """Apply an edit of ``operators.changes`` to its stored table; returns the stored results.

        Only the slices that hold a key of the batch are read and written, in place. A frame of
        the table that was asked for before lists files that may be gone: ask for it again.
        After a failure the batch can be applied again; what was stored of it then counts as there.
        """
        name, *others = EDITED[operator]
        self[name]
        operands = [self[other] for other in others]
        batch = dated(changes) if name == "Holiday" else changes
        numbers = touched_slices(self.spark, self.database, name, batch)
        part = read_slices(self.spark, self.database, name, numbers)
        rows, results = operator(part, *operands, batch)
        folder = f"{self.location}/_results/{uuid.uuid4().hex}"
        results.write.parquet(folder)  # judged by the rows as they are before
        if numbers:
            overwrite_slices(self.spark, self.database, name, rows, numbers)
        return self.spark.read.schema(results.schema).parquet(folder)

    def replace_all(self, tables: Mapping[str, DataFrame]) -> None:
        """Store new versions of several tables, such as a cascade changes, parents first.

        The new rows may read the old versions of any of them. Tables given as they are
        stored, without any operation on them, are left alone.
        """
        changed = {n: tables[n] for n in LOAD_ORDER if n in tables and not tables[n].sameSemantics(self[n])}
        for name, rows in changed.items():
            self.replace(name, rows)

    def append(
        self, raw: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]] | None = None
    ) -> dict[str, tuple[int, int]]:
        """Add a further batch of raw datasets: (rows accepted, rows rejected) by table.

        The batch is cleaned by itself, then checked against the stored tables: a key that is
        stored is a duplicate, so the first insert wins across loads, and parents may be
        stored or in the batch. Datasets that are left out add nothing. Accepted rows become
        further files of their buckets. The tables are appended to one after the other,
        parents first; after a failure the batch can be appended again, as what was stored of
        it is then rejected as duplicates.
        """
        clean = prepare_tables(raw, order, prices=self)
        daily = self._daily_folder()
        known = is_finished(self.spark, daily)
        before = {name: set(self[name].inputFiles()) for name in _PRICED if known}
        counts = {}
        for name in LOAD_ORDER:
            stored = self[name]
            if DATASETS[name] in raw:
                rows = self._cleaned_batch(name, clean[name])
                judged = judge_table(TABLES[name], rows, self, cleaned=True, existing=stored)
                counts[name] = write_judged(self.spark, self.database, name, judged, append=True)
                self._count(name, counts[name])
        if known:
            self._move_daily(daily, before)
        return counts

    def _cleaned_batch(self, name: str, rows: DataFrame) -> DataFrame:
        """A cleaned batch from files: it is read for its keys and for its rows, but made once."""
        folder = f"{self.location}/_batches/{name}_{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def daily_revenue(self) -> DataFrame:
        """The stored revenue by store and day, which the reports of revenue take as ``daily``.

        An append moves it by what the new rows change. After any other change of sales or
        prices it is made anew at the next use; stores and cities are not part of it.
        """
        for name in _PRICED:
            self[name]
        folder = self._daily_folder()
        if not is_finished(self.spark, folder):
            self._write_daily(folder, reports.daily_revenue(*(self[name] for name in _PRICED)))
        return self.spark.read.schema(_DAILY).parquet(folder)

    def _daily_folder(self) -> str:
        return f"{self.location}/_daily_revenue/{stored_state(self.spark, self.database, _PRICED)}"

    def _write_daily(self, folder: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(folder)

    def _move_daily(self, last: str, before: dict[str, set[str]]) -> None:
        """Store the summary of the tables as an append left them, from the one before it."""
        folder = self._daily_folder()
        if folder == last:
            return

        def added(name: str) -> DataFrame:
            files = sorted(set(self[name].inputFiles()) - before[name])
            table = TABLES[name].schema
            return self.spark.read.schema(table).parquet(*files) if files else empty_rows(self.spark, table)

        change = reports.daily_revenue_change(added("Sold"), self["Sold"], added("OnSale"), self["OnSale"], self["Product"])
        rows = self.spark.read.schema(_DAILY).parquet(last).unionByName(change)
        summed = rows.groupBy("StoreNumber", "CalendarDate").agg(money_sum(F.col("amount")).alias("amount"))
        self._write_daily(folder, summed)

    def create_views(self, category: str = GROUNDHOG_CATEGORY) -> None:
        """Create or replace the three views in the warehouse's database; loads no table."""
        create_catalog_views(self.spark, self.database, category)

    def view(self, name: str) -> DataFrame:
        """A view, after loading only the tables it reads."""
        for table in VIEW_TABLES[name]:
            self[table]
        if not self.spark.catalog.tableExists(f"`{self.database}`.`{name}`"):
            self.create_views()
        return self.spark.table(f"`{self.database}`.`{name}`")

    def rejects(self, name: str) -> DataFrame:
        """The cleaned rows that the loads of a table left out, as text with the reason."""
        self[name]
        return read_rejects(self.spark, self.database, name)

    def _count(self, name: str, counts: tuple[int, int]) -> None:
        before = self.counts.get(name, (0, 0))
        self.counts[name] = (before[0] + counts[0], before[1] + counts[1])

    def _load(self, name: str) -> None:
        spec = TABLES[name]
        parents = {key.parent: self[key.parent] for key in spec.foreign_keys}
        judged = judge_table(spec, self._clean[name], parents, cleaned=True)
        self._count(name, write_judged(self.spark, self.database, name, judged))
        self._loaded.add(name)
