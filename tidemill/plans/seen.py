"""Keys that earlier runs or micro-batches have seen.

Each batch has a number and writes the keys that it saw first into a folder of its own, which replaces
what an earlier try of the batch wrote.  A batch looks only at folders of smaller numbers, so doing it
again gives the same rows.  From time to time the folders become one table bucketed by key, which a
join then reads without shuffling it; keys older than ``ttl`` seconds are left out there and
in look-ups.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import as_text, col
from tidemill.sources.base import Folder
from tidemill.sources.commits import Publication, recover

#: Folders of single batches that are joined as they are; more become one table.
MOST_FOLDERS = 16


class SeenKeys:
    """The keys (as text; null is a value) of one rule or extraction, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, ttl: float | None = None, buckets: int = 64):
        self.spark, self.path, self.ttl, self.buckets = spark, path.rstrip("/"), ttl, buckets

    # -- what there is ---------------------------------------------------------------

    def _batches(self) -> dict[int, str]:
        top = Folder(self.spark, f"{self.path}/batches")
        if not top.exists():
            return {}
        names = [s.getPath().getName() for s in top.fs.listStatus(top.path)]
        return {int(n.split("=")[1]): f"{self.path}/batches/{n}" for n in sorted(names) if n.startswith("number=")}

    def _base(self) -> dict | None:
        """The bucketed table that stands for the batches up to its number."""
        note = Folder(self.spark, f"{self.path}/base.json")
        if not note.exists():
            return None
        stream = note.fs.open(note.path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _table(self, base: dict, width: int) -> DataFrame:
        name = f"tidemill_seen_{base['id']}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join([*(f"k{i} string" for i in range(width)), "at double"])
            keys = ", ".join(f"k{i}" for i in range(width))
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {base['buckets']} BUCKETS LOCATION '{self.path}/base-{base['id']}'")
        return self.spark.table(name)

    def known(self, number: int, at: float, width: int) -> DataFrame | None:
        """The keys (k0, k1, ..) of batches before ``number``, each once; none if there are no such batches."""
        base = self._base()
        if base and base["number"] >= number:
            raise ValueError(f"batch {number} is older than what is kept for replays")
        frames = [self._table(base, width)] if base else []
        some = [p for n, p in self._batches().items() if n < number and (not base or n > base["number"])]
        if some:
            frames.append(self.spark.read.schema(", ".join([*(f"k{i} string" for i in range(width)), "at double"])).parquet(*some))
        if not frames:
            return None
        found = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        found = found.where(F.col("at") > at - self.ttl) if self.ttl is not None else found
        return found.select(*(f"k{i}" for i in range(width)))

    # -- what a batch asks and leaves ------------------------------------------------

    def flagged(self, df: DataFrame, keys: list[str], number: int, at: float, name: str) -> DataFrame:
        """``df`` with a column that says whether an earlier batch has seen the row's key."""
        known = self.known(number, at, len(keys))
        if known is None:
            return df.withColumn(name, F.lit(False))
        known = known.distinct().withColumn(name, F.lit(True))
        same = None
        for i, k in enumerate(keys):
            one = as_text(col(k), df.schema[k].dataType).eqNullSafe(known[f"k{i}"])
            same = one if same is None else same & one
        joined = df.join(known, same, "left")
        return joined.select(*(df[f"`{c}`"] for c in df.columns), F.coalesce(known[name], F.lit(False)).alias(name))

    def unseen(self, df: DataFrame, keys: list[str], number: int, at: float) -> DataFrame:
        """The rows whose key no earlier batch has seen."""
        return self.flagged(df, keys, number, at, "__seen").where("NOT __seen").drop("__seen")

    def record(self, df: DataFrame, keys: list[str], number: int, at: float) -> None:
        """Keep the keys of ``df`` as those of batch ``number``; an earlier try's are replaced."""
        made = df.select(*(as_text(col(k), df.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys))).distinct()
        target = Folder(self.spark, f"{self.path}/batches/number={number}")
        recover(self.spark, target.path.toString())
        target.fs.mkdirs(target.path.getParent())
        staging = target.sibling()
        made.withColumn("at", F.lit(float(at))).write.parquet(staging.path.toString())
        publication = Publication(self.spark)
        publication.add(staging, target, "overwrite")
        publication.commit()

    def compact(self, number: int, at: float, width: int, most: int = MOST_FOLDERS) -> bool:
        """Once there are more than ``most`` batch folders below ``number``, make them one table; batches up to there can't be replayed any more."""
        base = self._base()
        some = {n: p for n, p in self._batches().items() if n < number}
        if len(some) <= most:
            return False
        keys = [f"k{i}" for i in range(width)]
        frames = ([self._table(base, width)] if base else []) + [self.spark.read.parquet(p) for n, p in some.items() if not base or n > base["number"]]
        every = frames[0]
        for more in frames[1:]:
            every = every.unionByName(more)
        every = every.where(F.col("at") > at - self.ttl) if self.ttl is not None else every
        # a key that has come back after its time counts from then on
        every = every.groupBy(*keys).agg(F.max("at").alias("at"))
        new = {"id": uuid.uuid4().hex, "number": max(some), "buckets": self.buckets}
        writer = every.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).option("path", f"{self.path}/base-{new['id']}")
        writer.saveAsTable(f"tidemill_seen_{new['id']}")
        note = Folder(self.spark, f"{self.path}/base.json")
        draft = note.sibling()
        stream = draft.fs.create(draft.path, True)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        draft.replace(note)
        for path in some.values():
            Folder(self.spark, path).delete()
        if base:
            self.spark.sql(f"DROP TABLE IF EXISTS tidemill_seen_{base['id']}")
            Folder(self.spark, f"{self.path}/base-{base['id']}").delete()
        return True
