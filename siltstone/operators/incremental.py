"""Problem 2: processing only new or changed records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.expressions import valid_record
from siltstone.functions.joins import join_small
from siltstone.sources.published import Folder


def read_frontier(edits: DataFrame, headers: DataFrame) -> DataFrame:
    """(db_id, frontier): the first log file of each store that has not been read.

    Every synced counter row names a file: ``current_wal_id``, or where that is
    null the file whose readable header (version 1) starts at
    ``next_sequence_number``; with both null, or no such header, it names none.
    The greatest named file counts, so counters that go back do no harm. Stores
    without a naming row are absent.
    """
    synced = (F.col("op") == "counter") & (F.col("commit_state") == "synced")
    named = edits.where(synced).select("db_id", "current_wal_id", "next_sequence_number").distinct()
    direct = named.where(F.col("current_wal_id").isNotNull()).select("db_id", F.col("current_wal_id").alias("wal_id"))
    starts = headers.where(F.col("version") == 1).select(
        "db_id", "wal_id", F.col("start_seq").alias("next_sequence_number")
    )
    looked_up = (
        named.where(F.col("current_wal_id").isNull())
        .join(starts.distinct(), ["db_id", "next_sequence_number"])
        .select("db_id", "wal_id")
    )
    return direct.unionByName(looked_up).groupBy("db_id").agg(F.max("wal_id").alias("frontier"))


def split_log(changelog: DataFrame, edits: DataFrame, headers: DataFrame) -> DataFrame:
    """Valid records of the log with ``was_read``: whether their file lies before the store's frontier.

    A record without a wal_id belongs to no file and is left out. Columns of the
    log that are called frontier or was_read are replaced.
    """
    valid = changelog.drop("frontier", "was_read").where(valid_record() & F.col("wal_id").isNotNull())
    marked = join_small(valid, read_frontier(edits, headers), ["db_id"], "left")
    return marked.withColumn("was_read", F.coalesce(F.col("wal_id") < F.col("frontier"), F.lit(False))).drop("frontier")


def new_records(source: DataFrame, target: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose identity (key and version) no row of ``target`` has, each identity once.

    The target is the only state: its rows carry the source key and version, so
    a run that failed before publishing left no trace and a run that published
    can't be repeated. Both sides are reduced to distinct identities before they
    meet (with a map-side partial), so repeats of one hot key cost nothing, and
    the version in the identity spreads a hot key over all partitions. The join
    shuffles on exactly the identity the reduction shuffled on, so neither side
    moves twice. Null parts compare as equal.
    """
    # As one struct the identity is compared field by field, nulls as equal, and stays the key both sides are
    # partitioned on; null-safe comparisons of single columns would need another shuffle.
    whole = F.struct(*identity).alias("_identity")
    fresh, seen = source.select(whole).distinct(), target.select(whole).distinct()
    return fresh.join(seen, "_identity", "left_anti").select("_identity.*")


class IncrementalTarget:
    """A versioned target table in a shared folder, which is at the same time the state of its runs.

    ``run`` anti-joins the source against the current version, writes the rows
    that are new to a folder of their own and publishes a new version, which
    lists the folders of its rows, by one atomic rename. A run that finds its
    version taken fails and has changed nothing. A run that dies earlier leaves
    a folder no version names: later runs ignore it, ``clean`` removes it.

    A version lists at most ``max_folders`` folders: beyond that a run rewrites
    the smaller half as one, so versions, their bodies and the scans of the next
    run stay small. The schema is part of the version; nothing is inferred.
    """

    def __init__(self, spark: SparkSession, path: str, identity: Sequence[str], max_folders: int = 64):
        self.spark, self.identity, self.max_folders = spark, list(identity), max_folders
        self._folder = Folder(spark, path)
        self.path = self._folder.path

    def version(self) -> int:
        """The newest published version, 0 before the first."""
        return self._folder.version()

    def _rows(self, state: dict, names: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, None before the first."""
        state = self._folder.state(version)
        return self._rows(state, state["folders"]) if state else None

    def run(
        self, source: DataFrame, process: Callable[[DataFrame], DataFrame] | None = None
    ) -> tuple[int, DataFrame]:
        """Process what is new in ``source``; the version published and the rows added by it.

        ``process`` may add columns but must keep the identity; rows it drops come up again in the next run.
        All versions have the columns of the first.
        """
        base = self.version()
        state = self._folder.state(base)
        have = self._rows(state, state["folders"]) if state else None
        fresh = source.select(*self.identity).distinct() if have is None else new_records(source, have, self.identity)
        rows = process(fresh) if process else fresh
        if missing := set(self.identity) - set(rows.columns):
            raise ValueError(f"the identity lacks {sorted(missing)}")
        if have is not None:
            rows = rows.select(*have.columns)
        folder = f"rows-{base + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        new = {"schema": state.get("schema") or rows.schema.jsonValue(), "folders": [*state.get("folders", []), folder], "added": folder}
        if len(new["folders"]) > self.max_folders:
            new["folders"] = self._merged(new, base + 1)
        self._folder.publish(base + 1, new)
        return base + 1, self._rows(new, [folder])

    def _merged(self, state: dict, version: int) -> list[str]:
        """The folders of a version with the smaller half of them, beside the newest, rewritten as one."""
        *old, newest = state["folders"]
        by_size = sorted(old, key=self._folder.size)
        small, rest = by_size[: len(old) // 2], by_size[len(old) // 2 :]
        name = f"rows-{version}-{uuid.uuid4().hex}"
        self._rows(state, small).coalesce(max(1, len(small))).write.parquet(f"{self.path}/{name}")
        return [*rest, name, newest]

    def clean(self, keep: int = 2) -> list[str]:
        """Remove what none of the ``keep`` newest versions names: left by runs that died, or merged. No run may be under way."""
        versions = self._folder.versions()
        for v in versions[: -keep or None]:
            self._folder.delete(f"version-{v}.json")
        kept = [self._folder.state(v) for v in versions[-keep:]]
        named = {n for s in kept for n in (*s["folders"], s["added"])}
        gone = [n for n in self._folder.names("rows-*") if n not in named] + self._folder.names(".pending-*")
        for n in gone:
            self._folder.delete(n)
        return gone
