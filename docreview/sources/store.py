"""A store of results by key: versions in folders of their own, visible once committed."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreview.constants import PAIR

_BASE = "base-"


class ResultStore:
    """Newest result per key, from versions that were written as a whole.

    A version (a run, or a batch of a stream) is a folder `version=<n>`; it counts from the moment
    that its record `_commits/<n>` exists. A version that was killed half-way is not seen, and
    writing it again replaces its folder; one that is committed is left as it is, so a replayed run
    or batch changes nothing. Readers take, per key, the row of the highest committed version.
    `compact` folds all versions up to n into `version=base-<n>`. One writer at a time per store; a read
    that runs while `compact` removes folders may have to be started again."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = PAIR, newest: str | None = None):
        """`newest` is the column by which the newest row of a key in one version wins; without it,
        or where it is equal, the greatest row does, whatever the order of reading."""
        self.spark, self.path, self.keys, self.newest = spark, path.rstrip("/"), list(keys), newest

    def _at(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _records(self) -> tuple[list[int], list[int]]:
        """Committed versions and bases: one name per run or batch since the last compaction."""
        fs, at = self._files(), self._at("_commits")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        bases = [int(n.removeprefix(_BASE)) for n in names if n.startswith(_BASE)]
        return sorted(int(n) for n in names if not n.startswith(_BASE)), sorted(bases)

    def versions(self) -> list[str]:
        """The folders to read, oldest first: the last base and what was committed after it."""
        versions, bases = self._records()
        last = bases[-1] if bases else None
        return ([f"{_BASE}{last}"] if bases else []) + [str(v) for v in versions if last is None or v > last]

    def write(self, results: DataFrame, version: int) -> None:
        """Add a version: the newest row per key of `results`."""
        versions, bases = self._records()
        if version in versions or any(version <= b for b in bases):
            return
        rows = self._newest(results, [self.newest] if self.newest else [])
        self._save(rows.withColumn("run_no", F.lit(version).cast("long")), str(version))

    def _save(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(self._at(f"version={name}").toString())
        self._files().create(self._at("_commits", name), False).close()

    def _newest(self, rows: DataFrame, order: list[str]) -> DataFrame:
        body = [c for c in rows.columns if c not in self.keys]
        row = F.struct(*[F.col(c) for c in body])
        # structs compare field by field, so the winning row of a key wins as a whole
        best = F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], row.alias("_row")))
        return rows.groupBy(*self.keys).agg(best.alias("_best")).select(*self.keys, *[F.col(f"_best._row.`{c}`") for c in body])

    def read(self) -> DataFrame | None:
        """The newest row of every key, with the version that brought it as run_no; None for an
        empty store. Rows are combined per key before the shuffle."""
        whole = None
        for name in self.versions():
            rows = self.spark.read.parquet(self._at(f"version={name}").toString())
            whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
        return None if whole is None else self._newest(whole, ["run_no"])

    def compact(self) -> None:
        """Fold what is committed into one folder and remove what that replaces. Killed before its
        commit it leaves the store as it was; killed after it, folders that the next call removes."""
        versions, bases = self._records()
        if versions and len(self.versions()) > 1:
            self._save(self.read(), f"{_BASE}{versions[-1]}")
            versions, bases = self._records()
        if bases:
            # a folder goes before its record, so that what is left over can be found again
            old = [str(v) for v in versions if v <= bases[-1]] + [f"{_BASE}{b}" for b in bases[:-1]]
            for name in old:
                self._files().delete(self._at(f"version={name}"), True)
                self._files().delete(self._at("_commits", name), False)
