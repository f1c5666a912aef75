"""Summary tables: written once and read by every report.

The first report that needs a summary takes a pass over the facts; the others then
written to the folder the cluster shares (``spark.checkpoint.dir``), so losing an
executor costs nothing but the re-read of a file. It lives as long as the application;
:func:`save` writes to a folder that outlives it and :func:`refresh` brings that
folder up to date.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import tempfile
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote, urlsplit
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.model import RetailModel
from tillbook.operators.reduction import reduced
from tillbook.operators.selection import check_range, within
from tillbook.operators.summaries import ORDER, SCHEMAS, item_kinds, store_balances, store_months

Facts = Callable[[], list[DataFrame]]
_kept: dict[tuple, list[tuple[list[DataFrame], str, str]]] = {}
_own_folder: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str | None:
    """Folder all executors see, or ``None`` when the cluster names none.

    What ``spark.checkpoint.dir`` names is taken for shared, as Spark itself takes it.
    Only a session on one machine may fall back to a temporary folder.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return None
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="tillbook-")
    return _own_folder.name


def _located(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path in it."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def is_folder(spark: SparkSession, path: str) -> bool:
    files, location = _located(spark, path)
    return files.getFileStatus(location).isDirectory()


def _states_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Location, size and time of change of every file behind an input, however deep."""
    files, location = _located(spark, path)
    found, listing = [], files.listFiles(location, True)
    while listing.hasNext():
        file = listing.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return sorted(found)


def _is_complete(spark: SparkSession, path: str) -> bool:
    files, location = _located(spark, f"{path}/_SUCCESS")
    return files.exists(location)


def write_summary(name: str, table: DataFrame, path: str) -> None:
    """Write a summary, in one folder per month if it has days.

    Rows of a month are sorted, so that parquet statistics can skip within it. Folded tables are
    clustered by day first: small days share a task and a day with very many rows
    is split over several. The joined facts are written as the join leaves them.
    """
    if "day" not in table.columns:
        table.repartitionByRange(*ORDER[name]).sortWithinPartitions(*ORDER[name]).write.parquet(path)
        return
    rows = table if name == "sold" else table.hint("rebalance", "day")
    (
        rows.withColumn("month", F.trunc("day", "month"))
        .sortWithinPartitions("month", *ORDER[name])
        .write.partitionBy("month")
        .parquet(path)
    )


def _schema_of(name: str, table: DataFrame) -> str:
    """Columns of a summary as stored; ids of transactions keep the type they came with."""
    kinds = {field.name: field.dataType.simpleString() for field in table.schema}
    return re.sub(r"transaction_id \w+", f"transaction_id {kinds.get('transaction_id')}", SCHEMAS[name])


#: Summaries without days of their own: what they are folded from, as a whole.
FOLDED = {
    "store_months": ("store_days", store_months),
    "store_balances": ("daily_store", store_balances),
    "item_kinds": ("item_hours", item_kinds),
}


def _unplaced(table: DataFrame) -> DataFrame:
    """A summary without the month that only tells where its days are stored."""
    return table.select(*(c for c in table.columns if c != "month" or "day" not in table.columns))


# ---- summaries beyond an application


def _months(spark: SparkSession, path: str) -> list[str]:
    """Month folders of a written summary; one without days is a single part."""
    files, location = _located(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(location)]
    months = [name.removeprefix("month=") for name in names if name.startswith("month=")]
    return months or ([] if "_SUCCESS" in names and not any(n.startswith("part-") for n in names) else [""])


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    files, location = _located(spark, folder)
    if not files.exists(location):
        return []
    names = [status.getPath().getName() for status in files.listStatus(location)]
    return sorted(int(found[1]) for name in names if (found := re.fullmatch(r"manifest-(\d+)\.json", name)))


def _current(spark: SparkSession, folder: str) -> dict:
    numbers = _manifests(spark, folder)
    if not numbers:
        raise FileNotFoundError(f"no summaries are saved in {folder}")
    lines = spark.read.text(f"{folder}/manifest-{numbers[-1]}.json", wholetext=True)
    return json.loads(lines.first()["value"])


def _publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Let readers see a new version: all of it from one moment to the next."""
    number = max(_manifests(spark, folder), default=0) + 1
    files, draft = _located(spark, f"{folder}/_draft-{uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    _, target = _located(spark, f"{folder}/manifest-{number}.json")
    if files.exists(target) or not files.rename(draft, target):
        raise RuntimeError(f"someone else has saved version {number} of {folder} meanwhile")


def _read_parts(spark: SparkSession, folder: str, name: str, manifest: dict) -> DataFrame:
    schema, parts = manifest["schemas"][name], manifest["parts"][name]
    by_root: dict[str, list[str]] = {}
    for month, root in sorted(parts.items()):
        by_root.setdefault(root, []).append(f"month={month}" if month else "")
    frames = [
        spark.read.schema(schema)
        .option("basePath", f"{folder}/{root}/{name}")
        .parquet(*(f"{folder}/{root}/{name}/{month}".rstrip("/") for month in months))
        for root, months in by_root.items()
    ]
    return reduce(DataFrame.unionAll, frames) if frames else spark.createDataFrame([], schema)


def save(model: RetailModel, folder: str) -> None:
    """Write all summaries to a folder of one's own, to be used by later sessions.

    Readers see the version before until all tables are there.
    """
    spark = model.transactions.sparkSession
    root = f"parts-{uuid4().hex}"
    manifest: dict = {"schemas": {}, "parts": {}}
    for name in SCHEMAS:
        table, path = getattr(model, name), f"{folder}/{root}/{name}"
        write_summary(name, _unplaced(table), path)
        manifest["schemas"][name] = _schema_of(name, table)
        manifest["parts"][name] = dict.fromkeys(_months(spark, path), root)
    _publish(spark, folder, manifest)


def saved(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Saved summaries, as ``given`` for a :class:`~tillbook.model.RetailModel`; those that the folder has."""
    manifest = _current(spark, folder)
    return {name: _read_parts(spark, folder, name, manifest) for name in manifest["schemas"]}


def refresh(
    model: RetailModel, folder: str, start: dt.date | str, end: dt.date | str
) -> None:
    """Derive the months from ``start`` to ``end`` again and replace only those.

    Transactions are read for these months only. Items carry no time, so those that may belong to
    these transactions are told by a filter of their ids as they are read, and only they are
    shuffled; with fact tables from :mod:`~tillbook.sources.facts` none is. Summaries that were given to the
    model are not derived but taken from it. A month without rows leaves the folder's
    tables. Other months stay as files, and readers see the version before until
    all is written.
    """
    spark = model.transactions.sparkSession
    first, last = check_range(start, end)
    following = (last.replace(day=1) + dt.timedelta(days=31)).replace(day=1)
    months = first.replace(day=1), following - dt.timedelta(days=1)
    given = {n: within(t, *months) if "day" in t.columns else t for n, t in model.given.items()}
    visits = within(model.transactions, *months)
    part = RetailModel(visits, lambda: reduced(model.items, visits, "transaction_id"), keep=_in_place(spark), given=given)
    manifest = _current(spark, folder)
    root = f"parts-{uuid4().hex}"

    def replace(name: str, table: DataFrame, changed: Callable[[str], bool]) -> None:
        path = f"{folder}/{root}/{name}"
        write_summary(name, _unplaced(table), path)
        left = {month: old for month, old in manifest["parts"][name].items() if not changed(month)}
        manifest["parts"][name] = left | dict.fromkeys(_months(spark, path), root)

    for name in SCHEMAS:
        if name not in FOLDED:
            replace(name, getattr(part, name), lambda m: str(months[0]) <= m <= str(months[1]))
    for name, (source, fold) in FOLDED.items():
        folded = model.given.get(name) or fold(_read_parts(spark, folder, source, manifest))
        replace(name, folded, lambda month: True)
    _publish(spark, folder, manifest)


def _in_place(spark: SparkSession):
    """A ``keep`` that writes what is used more than once, for a refresh."""
    folder = shared_folder(spark)
    if folder is None:
        return lambda name, build, facts: build()
    return lambda name, build, facts: _written(spark, folder, name, build())[0]


def replace_days(
    spark: SparkSession, folder: str, name: str, changed: DataFrame, writer: str, version: int
) -> bool:
    """Let the rows of ``changed`` replace those of their stores and days in a summary of the folder.

    Only months with changed days are written anew. The manifest keeps the last version of each writer: a version
    that is there already, as after a restart, is left alone and False returned. The folder is begun if it is new.
    """
    begun = bool(_manifests(spark, folder))
    manifest = _current(spark, folder) if begun else {"schemas": {}, "parts": {}}
    writers = manifest.setdefault("writers", {})
    if writers.get(writer, -1) >= version:
        return False
    manifest["schemas"].setdefault(name, SCHEMAS[name])
    parts = manifest["parts"].setdefault(name, {})
    root = f"parts-{uuid4().hex}"
    fresh = f"{folder}/{root}/changed"
    write_summary(name, changed, fresh)
    months = _months(spark, fresh)
    if months:
        rows = spark.read.schema(SCHEMAS[name]).parquet(fresh)
        before = {**manifest, "parts": {name: {month: parts[month] for month in months if month in parts}}}
        old, new = _read_parts(spark, folder, name, before), rows.select(F.col("store").alias("_store"), F.col("day").alias("_day"))
        replaced = F.col("store").eqNullSafe(F.col("_store")) & F.col("day").eqNullSafe(F.col("_day"))
        stay = old.join(new, replaced, "left_anti")
        write_summary(name, _unplaced(stay.unionByName(rows)), f"{folder}/{root}/{name}")
        parts |= dict.fromkeys(months, root)
    files, location = _located(spark, fresh)
    files.delete(location, True)
    writers[writer] = version
    if months or not begun:  # a batch without changes needs no version
        _publish(spark, folder, manifest)
    return True


def vacuum(spark: SparkSession, folder: str) -> None:
    """Remove versions that the current one has replaced, once no reader needs them."""
    manifest, numbers = _current(spark, folder), _manifests(spark, folder)
    used = {root for parts in manifest["parts"].values() for root in parts.values()}
    files, location = _located(spark, folder)
    for status in files.listStatus(location):
        name = status.getPath().getName()
        old = name.startswith("manifest-") and name != f"manifest-{numbers[-1]}.json"
        if old or (name.startswith("parts-") and name not in used):
            files.delete(status.getPath(), True)


# ---- summaries of an application


def application_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The application's own folder in the shared one."""
    place = folder or shared_folder(spark)
    if place is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{place}/tillbook/{spark.sparkContext.applicationId}"
    files, location = _located(spark, own)
    if not files.exists(location):
        files.mkdirs(location)
        files.deleteOnExit(location)
    return own


def _written(spark: SparkSession, folder: str, name: str, table: DataFrame) -> tuple[DataFrame, str, str]:
    """A summary in the application's own folder, which goes when the application ends."""
    path, schema = f"{application_folder(spark, folder)}/{name}-{uuid4().hex}", _schema_of(name, table)
    write_summary(name, table, path)
    return spark.read.schema(schema).parquet(path), path, schema


def keep_for_application(
    spark: SparkSession, inputs: Sequence[str], version: str | None = None, folder: str | None = None
) -> Callable[[str, Callable[[], DataFrame], Facts], DataFrame]:
    """A ``keep`` for :class:`~tillbook.model.RetailModel` over the given inputs.

    A kept summary is used again by a model whose tables mean the same (or that names the same
    ``version``, which saves the comparison) while every file of the inputs, however deep, has
    the name, size and time it had. Else it is built anew, also if it was removed. Where the
    model's tables read files outside the inputs, changes could not be noticed, so the
    summary stays a lazy part of each report's plan; so it does without a shared
    ``folder``, by default that of :func:`shared_folder`.
    """

    def keep(name: str, build: Callable[[], DataFrame], facts: Facts) -> DataFrame:
        place = folder or shared_folder(spark)
        if place is None:
            return build()
        states = tuple(state for path in inputs for state in _states_of(spark, path))
        sources = [] if version else facts()
        if not _covers(states, sources):
            return build()
        key = (spark.sparkContext.applicationId, version, place, name, states)
        for known, path, schema in _kept.get(key, ()):
            same = len(known) == len(sources) and all(a.sameSemantics(b) for a, b in zip(known, sources))
            if same and _is_complete(spark, path):
                return spark.read.schema(schema).parquet(path)
        table, path, schema = _written(spark, place, name, build())
        _kept.setdefault(key, []).append((sources, path, schema))
        return table

    return keep


def _covers(states: tuple, sources: list[DataFrame]) -> bool:
    known = {urlsplit(path).path for path, _, _ in states}
    return all(unquote(urlsplit(file).path) in known for frame in sources for file in frame.inputFiles())


def forget(name: str | None = None) -> None:
    """Build every summary, or those of one name, anew at the next use.

    The tables stay until the application ends, as frames may still read them.
    """
    for key in [key for key in _kept if name in (None, key[3])]:
        del _kept[key]
