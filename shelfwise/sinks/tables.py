"""Tables written by the jobs.

Writes are keyed by batch id: a batch that runs twice, because a task or the driver was
lost, overwrites its own folder and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.tables import BATCH, DAY

_FOLDED = "writer string, batch long"


def append(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append rows; with a batch id the append is repeatable."""
    if batch_id is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def append_by_day(df: DataFrame, path: str, time_column: str, batch_id: int) -> None:
    """Append a batch laid out by the day of ``time_column``; ``read_lookback`` then opens only the days it needs.

    A batch that runs again overwrites its own folders of each day. A day's rows are dealt over as many writers as
    their number asks for (AQE splits a large day), so a batch leaves few files a day.
    """
    dated = df.withColumn(DAY, F.to_date(time_column)).withColumn(BATCH, F.lit(batch_id))
    dated.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        DAY, BATCH
    ).parquet(path)


def _exists(spark: SparkSession, pattern: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [str(s.getPath().toString()) for s in found] if found else []


@dataclass(frozen=True)
class KeyedTable:
    """Upserts as an append-only log per batch, merged on read and compacted from time to time.

    A batch writes only its own rows, however large the table is. Every writer has folders of its
    own, so jobs that count their batches alike do not meet; a batch counts once its success marker
    is there. The newest row per key is the one with the greatest ``order``; ``deleted`` names a
    flag that removes the key. With ``first`` the row with the least ``order`` stays for good: an
    insert that ignores known keys, with nothing read before a write, safe to replay and for
    several writers.
    """

    path: str
    keys: Sequence[str]
    order: Sequence[str]
    deleted: str | None = None
    log: str = field(default="log")
    first: bool = False

    def _newest(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.keys]
        pick = F.min_by if self.first else F.max_by
        newest = pick(F.struct(*rest), F.struct(*self.order)).alias("_r")
        return df.groupBy(*self.keys).agg(newest).select(*self.keys, "_r.*").select(*df.columns)

    def upsert(self, df: DataFrame, batch_id: int, writer: str = "main") -> None:
        place = f"{self.path}/{self.log}/writer={writer}/batch={batch_id}"
        self._newest(df).write.mode("overwrite").parquet(place)

    def _base(self, spark: SparkSession) -> str | None:
        """Folder of the newest committed base; one of the old layout, which names no batches, counts as the oldest."""
        done = _exists(spark, f"{self.path}/base/version=*/rows/_SUCCESS")
        if done:
            return max((p[: -len("/rows/_SUCCESS")] for p in done), key=lambda p: (self._version(p), p))
        old = [p.rsplit("/", 1)[0] for p in _exists(spark, f"{self.path}/base/upto=*/_SUCCESS")]
        return max(old, key=lambda p: int(p.rsplit("upto=", 1)[1]), default=None)

    @staticmethod
    def _version(base: str) -> int:
        return int(base.rsplit("version=", 1)[1].split("-")[0]) if "version=" in base else 0

    def _batches(self, spark: SparkSession) -> dict[tuple[str, int], str]:
        """Folders of the finished batches by writer and number."""
        done = _exists(spark, f"{self.path}/{self.log}/writer=*/batch=*/_SUCCESS")
        places = [p.rsplit("/", 1)[0] for p in done]
        names = [p.rsplit("writer=", 1)[1].rsplit("/batch=", 1) for p in places]
        return {(writer, int(number)): p for (writer, number), p in zip(names, places)}

    def _folded(self, spark: SparkSession, base: str | None) -> set[tuple[str, int]]:
        """The batches that ``base`` holds."""
        if base is None or "version=" not in base:
            return set()
        return {(r["writer"], r["batch"]) for r in spark.read.schema(_FOLDED).parquet(f"{base}/folded").collect()}

    def _merged(self, spark: SparkSession, base: str | None, later: Sequence[str]) -> DataFrame:
        """The base and the batches after it."""
        rows = f"{base}/rows" if base and "version=" in base else base
        parts = [spark.read.parquet(rows)] if rows else []
        if later:
            parts.append(spark.read.parquet(*later))
        if not parts:
            raise FileNotFoundError(f"no committed rows under {self.path}")
        if len(parts) == 2:
            parts = [parts[0].unionByName(parts[1].select(*parts[0].columns))]
        return self._newest(parts[0]) if later else parts[0]

    def exists(self, spark: SparkSession) -> bool:
        return self._base(spark) is not None or bool(self._batches(spark))

    def read(self, spark: SparkSession) -> DataFrame:
        """Current rows, one per key."""
        base = self._base(spark)
        folded = self._folded(spark, base)
        rows = self._merged(spark, base, [p for k, p in self._batches(spark).items() if k not in folded])
        return rows.filter(~F.col(self.deleted)).drop(self.deleted) if self.deleted else rows

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Fold every writer's batches up to ``upto`` into one base; readers switch once it is committed.

        The base names the batches it holds, by writer and number, and only those are passed over
        from then on: a replay of one changes nothing any more, while a batch first committed after
        the compaction counts, whatever its number.
        """
        base = self._base(spark)
        folded = self._folded(spark, base)
        later = {k: p for k, p in self._batches(spark).items() if k not in folded and k[1] <= upto}
        if base is not None and not later:
            return
        rows = self._merged(spark, base, list(later.values()))
        place = f"{self.path}/base/version={self._version(base or '') + 1}-{uuid.uuid4().hex}"
        spark.createDataFrame(sorted(folded | later.keys()), _FOLDED).coalesce(1).write.parquet(f"{place}/folded")
        rows.write.parquet(f"{place}/rows")  # its success marker commits the base


def insert_ignore(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Insert rows whose key is not stored yet; of equal new keys one row goes in.

    For one writer and no replays: it looks keys up before it appends. ``insert_table`` needs neither.
    """
    spark = df.sparkSession
    fresh = df.dropDuplicates(list(keys))
    if _exists(spark, f"{path}/*.parquet"):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)


def insert_table(path: str, keys: Sequence[str], order: Sequence[str]) -> KeyedTable:
    """A table that keeps the first row of each key by ``order``, whoever writes it and however often."""
    return KeyedTable(path, tuple(keys), tuple(order), first=True)


def dimension(path: str, keys: Sequence[str]) -> KeyedTable:
    return KeyedTable(path, tuple(keys), ("op_ts", "deleted"), deleted="deleted")


def publish_dim(changes: DataFrame, table: KeyedTable, batch_id: int, writer: str = "main") -> None:
    """Write latest changes (keys, op, op_ts, after) to a keyed dimension; deletes leave a tombstone."""
    rest = [c for c in changes.select("after.*").columns if c not in table.keys]
    rows = changes.select(
        *table.keys, *[F.col(f"after.{c}") for c in rest], "op_ts", (F.col("op") == "d").alias("deleted")
    )
    table.upsert(rows, batch_id, writer)


def read_dim(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """Keyed dimension as of now: latest row per key, deletes honoured."""
    return table.read(spark)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
