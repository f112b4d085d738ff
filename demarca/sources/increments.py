"""Stored summaries that are refreshed by what changed in their source.

A summary keeps, for each unit of its source (a partition folder or a file), the states of
its keys: counts, sums, minimums, maximums, and for modes the counts per category. A
refresh compares the files of every unit with those of the last one, computes the states
of new and changed units only, drops those of units that are gone, merges what there is
and commits. States are never subtracted, so any merge works and nothing drifts.

Below a summary's folder, ``states/<n>`` holds the states made by refresh ``n``, ``rows/<n>``
its result and ``commits/<n>.json`` the manifest. The manifest is written last and created
exclusively: a refresh that fails before it leaves the former result in force, and of two
at the same time one fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNIT, FOLDER = "_unit", "_folder"

#: State folders beyond which a refresh writes all states into one.
MOST_FOLDERS = 32

MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


class StaleSummary(ValueError):
    """The source changed after the last refresh."""


class MissingSummary(ValueError):
    """There is no committed refresh of this definition."""


@dataclass(frozen=True)
class Summary:
    """What is kept and how it is finished.

    ``state(rows, keys)`` aggregates source rows by the given keys, which are ``keys`` and
    the unit. ``merge`` names how each of its measures is merged over units: sum, min or
    max. ``finish`` turns the merged states into the summary's rows. Change ``version``
    with the definition; states of another one are not used. ``unit`` is "folder" (of a
    partitioned table) or "file".
    """

    name: str
    keys: tuple[str, ...]
    state: Callable[[DataFrame, list[str]], DataFrame]
    merge: dict[str, str]
    finish: Callable[[DataFrame], DataFrame] = lambda merged: merged
    version: str = "1"
    unit: str = "folder"

    def definition(self) -> str:
        return json.dumps([self.name, self.keys, self.merge, self.version, self.unit])

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.keys).agg(*[MERGES[how](name).alias(name) for name, how in self.merge.items()])


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: its number, and the units it computed and dropped."""

    version: int
    computed: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


def fingerprints(spark: SparkSession, source: str, unit: str = "folder") -> dict[str, str]:
    """A digest of the names, sizes and times of the files of each unit; no file is opened.

    A unit is named by its path below the source; the files of a table without partitions
    are the unit "" where units are folders.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(source)
    within = F.substring_index(_below(spark, source), "/", -1)
    path = _below(spark, source)
    own = path if unit == "file" else F.left(path, F.greatest(F.length(path) - F.length(within) - 1, F.lit(0)))
    mark = F.xxhash64(path, "_metadata.file_size", "_metadata.file_modification_time").cast("decimal(38,0)")
    marks = files.groupBy(own.alias("unit")).agg(F.sum(mark).alias("marks"), F.count("*").alias("n"))
    return {r.unit: f"{r.n}:{r.marks}" for r in marks.collect()}


def live(spark: SparkSession, summary: Summary, source: str) -> DataFrame:
    """The summary's rows from the whole source."""
    rows = spark.read.parquet(source).withColumn(UNIT, F.lit(""))
    return summary.finish(summary.merged(summary.state(rows, [UNIT, *summary.keys])))


def refresh(spark: SparkSession, summary: Summary, source: str, root: str) -> Refresh:
    """Bring the stored summary up to date with a Parquet table; unchanged units are not read.

    Nothing is written if nothing changed. An empty table gives an empty summary. The
    driver handles one digest per unit.
    """
    own = f"{root}/{summary.name}"
    known = _manifest(spark, summary, own)
    now, before = fingerprints(spark, source, summary.unit), known["units"] if known else {}
    changed = sorted(u for u, digest in now.items() if u not in before or before[u][0] != digest)
    gone = sorted(set(before) - set(now))
    if known and not changed and not gone:
        return Refresh(known["version"])
    version = max([0, *_commits(spark, own)]) + 1
    folder = f"{own}/states/{version}"
    schema = StructType.fromJson(known["schema"]) if known else spark.read.parquet(source).schema
    made = _state_rows(spark, summary, source, schema, changed).withColumn(FOLDER, F.lit(str(version)))
    made.write.mode("overwrite").parquet(folder)
    units = {u: [digest, str(version) if u in changed else before[u][1]] for u, digest in now.items()}
    states = _states(spark, own, units, made.schema)
    if len({f for _, f in units.values()}) > MOST_FOLDERS:
        whole = f"{version}-all"
        states.withColumn(FOLDER, F.lit(whole)).write.mode("overwrite").parquet(f"{own}/states/{whole}")
        units = {u: [digest, whole] for u, (digest, _) in units.items()}
        states = _states(spark, own, units, made.schema)
    summary.finish(summary.merged(states)).write.mode("overwrite").parquet(f"{own}/rows/{version}")
    about = {"version": version, "definition": summary.definition(), "schema": schema.jsonValue(), "units": units}
    _commit(spark, f"{own}/commits/{version}.json", about)
    return Refresh(version, changed, gone)


def stored(spark: SparkSession, summary: Summary, source: str, root: str) -> DataFrame:
    """The rows of the last committed refresh; raises if there is none or the source has changed since."""
    known = _manifest(spark, summary, f"{root}/{summary.name}")
    if not known:
        raise MissingSummary(f"no committed refresh of {summary.name}")
    now = fingerprints(spark, source, summary.unit)
    old = {u: digest for u, (digest, _) in known["units"].items()}
    if now != old:
        units = sorted(u for u in {*now, *old} if now.get(u) != old.get(u))
        raise StaleSummary(f"{summary.name}: {len(units)} units changed after refresh {known['version']}, such as {units[0]!r}")
    return spark.read.parquet(f"{root}/{summary.name}/rows/{known['version']}")


def stored_or_live(spark: SparkSession, summary: Summary, source: str, root: str) -> DataFrame:
    """The stored rows if they are committed and of the source as it is, else the same rows from the source."""
    try:
        return stored(spark, summary, source, root)
    except (MissingSummary, StaleSummary):
        return live(spark, summary, source)


def vacuum(spark: SparkSession, summary: Summary, root: str) -> list[str]:
    """Remove folders and manifests that the last commit doesn't use; no refresh or older reader may be running."""
    own = f"{root}/{summary.name}"
    known = _manifest(spark, summary, own)
    if not known:
        return []
    used = {f"states/{f}" for _, f in known["units"].values()}
    used |= {f"rows/{known['version']}", f"commits/{known['version']}.json"}
    removed = []
    for kind in ("states", "rows", "commits"):
        for path in _listed(spark, f"{own}/{kind}"):
            if f"{kind}/{path.getName()}" not in used:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                removed.append(f"{kind}/{path.getName()}")
    return sorted(removed)


def _below(spark: SparkSession, source: str) -> Column:
    """The path of a row's file below the source, as a URI has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    scheme = "^([A-Za-z0-9+.-]+):/*"
    root = F.regexp_replace(F.lit(whole), scheme, "$1:/")
    return F.substr(F.regexp_replace("_metadata.file_path", scheme, "$1:/"), F.length(root) + 2)


def _state_rows(spark: SparkSession, summary: Summary, source: str, schema: StructType, units: list[str]) -> DataFrame:
    """States of some units, from their files alone; ``schema`` is that of the whole table at the first refresh."""
    table = spark.read.schema(schema).option("basePath", source)
    rows = table.parquet(*[f"{source}/{unquote(u)}".rstrip("/") for u in units] or [source])
    path = _below(spark, source)
    folder = F.left(path, F.greatest(F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1, F.lit(0)))
    rows = rows.withColumn(UNIT, path if summary.unit == "file" else folder)
    return summary.state(rows if units else rows.where(F.lit(False)), [UNIT, *summary.keys])


def _states(spark: SparkSession, own: str, units: dict[str, list[str]], schema: StructType) -> DataFrame:
    """The states in force: of each unit those of its own folder."""
    folders = sorted({f for _, f in units.values()})
    if not folders:
        return spark.createDataFrame([], schema)
    current = spark.createDataFrame([(u, f) for u, (_, f) in units.items()], f"{UNIT} string, {FOLDER} string")
    return spark.read.schema(schema).parquet(*[f"{own}/states/{f}" for f in folders]).join(current, [UNIT, FOLDER])


def _listed(spark: SparkSession, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath() for status in fs.listStatus(path)] if fs.exists(path) else []


def _commits(spark: SparkSession, own: str) -> list[int]:
    names = [path.getName() for path in _listed(spark, f"{own}/commits")]
    return [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]


def _manifest(spark: SparkSession, summary: Summary, own: str) -> dict | None:
    """The last whole manifest of this definition. One that was cut off while it was written doesn't count."""
    for version in sorted(_commits(spark, own), reverse=True):
        text = "".join(r.value for r in spark.read.text(f"{own}/commits/{version}.json", wholetext=True).collect())
        try:
            body = json.loads(text)
        except json.JSONDecodeError:
            continue
        return body if body["definition"] == summary.definition() else None
    return None


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write a manifest under a name that nobody else may have taken."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
