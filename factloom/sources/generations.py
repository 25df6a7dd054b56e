"""Generations of a set of tables, committed in two steps, so that readers see all tables of one generation or of the one before.

First the data of a generation are written, each table (or each of its buckets) in a folder of its own that nothing
refers to yet. Then one file, the manifest of the generation, says which folders make up every table. A failure before that file
leaves readers on the generation before; the same generation can be written again, and one that is committed already is
left alone. Nothing is ever overwritten that a committed manifest names, so there is nothing to restore.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, bucket int, folder string, derived_from long"


class Generations:
    """Tables below `base`, a folder that driver and executors share. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        spark.createDataFrame([], MANIFEST).coalesce(1).write.mode("ignore").parquet(f"{self.base}/commits/generation=0")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(f"{MANIFEST}, generation long").parquet(f"{self.base}/commits")

    def number(self) -> int:
        """The newest committed generation; 0 before the first."""
        return self._commits().agg(F.max("generation")).first()[0] or 0

    def manifest(self, generation: int | None = None) -> list:
        """Rows (name, bucket, folder, derived_from) of a generation: one a table or bucket, none a row of data."""
        at = self.number() if generation is None else generation
        return self._commits().filter(F.col("generation") == at).select("name", "bucket", "folder", "derived_from").collect()

    def read(self, name: str, schema: str, generation: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of one generation (the newest), empty if it was never written; only the folders of some buckets, if given."""
        wanted = None if buckets is None else set(buckets)
        folders = [r["folder"] for r in self.manifest(generation) if r["name"] == name and (wanted is None or r["bucket"] in wanted)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, generation: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, merge: dict[str, tuple[DataFrame, Iterable[int]]] | None = None, derived: Iterable[str] = ()) -> bool:
        """Write a generation and commit it; False, and nothing is done, if it is committed already.

        replace: whole tables; append: rows beside those of earlier generations; merge: (rows with a column bucket, the
        buckets that they replace), other buckets stay. What is not named stays as it was. Tables named in `derived`
        note the generation whose sources they were made from, this one.
        """
        before = self.number()
        if generation <= before:
            return False
        kept, made = {(r["name"], r["bucket"], r["folder"]): r["derived_from"] for r in self.manifest(before)}, {}
        for name, df in (replace or {}).items():
            kept = {k: v for k, v in kept.items() if k[0] != name}
            made[name, None, self._written(df, name, generation)] = generation if name in derived else None
        for name, df in (append or {}).items():
            made[name, None, self._written(df, name, generation)] = generation if name in derived else None
        for name, (df, buckets) in (merge or {}).items():
            gone = set(buckets)
            kept = {k: v for k, v in kept.items() if k[0] != name or k[1] not in gone}
            folder = self._written(df, name, generation, "bucket")
            filled = self.spark.read.schema(df.schema).parquet(folder).select("bucket").distinct().collect()  # a row a bucket
            made |= {(name, r["bucket"], f"{folder}/bucket={r['bucket']}"): generation if name in derived else None for r in filled}
        rows = [(*k, v) for k, v in (kept | made).items()]
        # one file, and a file appears whole or not at all
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.base}/commits/generation={generation}")
        return True

    def _written(self, df: DataFrame, name: str, generation: int, by: str | None = None) -> str:
        folder = f"{self.base}/data/{name}/generation={generation}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        return folder

    def check_derived(self, name: str, sources: Iterable[str]) -> None:
        """Raise if a source was committed after the generation that `name` was derived from: what shows both would mix
        two generations."""
        rows = self.manifest()
        made = max((r["derived_from"] or 0 for r in rows if r["name"] == name), default=0)
        for r in rows:
            own = int(r["folder"].rpartition("generation=")[2].split("/")[0])
            if r["name"] in set(sources) and own > made:
                raise ValueError(f"{r['name']} is of generation {own}, {name} was derived from {made}")
