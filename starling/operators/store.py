"""The vector store: immutable base versions in Parquet, a change log, compaction and reconciliation.

Layout of a folder that driver and executors share:

    base/<version>-<unique>/part=<p>/...   the rows of a version, tombstones among them
    changes/commit=<n>/                    the change rows of commit n; it counts once it has a _SUCCESS file
    graph/<the base's name>/part=<p>/...   proximity graphs of that version, built for some or all partitions
    versions/<n>                           a pointer: version, base, commit up to which all changes are folded, last id, end mark

A version is published by creating its pointer, which fails where another writer created it first (X11); a pointer is never changed,
and one without its end mark doesn't count. So a writer that dies leaves the last version as it was. Commits number arrivals and
decide what is folded; `seq` orders the changes of one id, also against those folded long before, wherefore the base keeps the
winning seq of each id and the tombstones of deleted ones. Appending commits is for one writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, NotFound, ValidationError, check_count, check_dimension
from ..functions.embed import embedder
from ..schema import CHANGES, PARTITIONS, VECTORS, part_of
from ..sources import files
from . import overlay, search, stats

BASE = VECTORS + ", seq long, op string"
END = "end"


@dataclass(frozen=True)
class Version:
    number: int
    base: str
    commit: int  # changes up to this commit are in the base
    last_id: int


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, dim: int, partitions: int = PARTITIONS):
        """Opens the store at the path; an absent or empty folder becomes an empty store. A folder that holds data but no readable
        version is an error, as starting anew would hide it."""
        self.spark, self.path, self.dim, self.partitions = spark, path.rstrip("/"), dim, partitions
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        if self._version() is None:
            if self._names("base") or self._names("changes") or self._names("versions"):
                raise ValueError(f"{self.path} holds data but no complete version")
            self._publish(self._no_rows(), None, 0, 0)

    # ------------------------------------------------------------------ versions

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name))] if self._fs.exists(self._path(name)) else []

    def _no_rows(self) -> DataFrame:
        return self.spark.createDataFrame([], BASE)

    def _version(self) -> Version | None:
        """The highest complete version."""
        for n in sorted((int(x) for x in self._names("versions") if x.isdigit()), reverse=True):
            found = self.spark.read.text(f"{self.path}/versions/{n}").first()
            words = (found["value"] if found else "").split()
            if len(words) == 4 and words[3] == END:
                return Version(n, words[0], int(words[1]), int(words[2]))
        return None

    def _publish(self, rows: DataFrame, over: Version | None, commit: int, last_id: int) -> None:
        """Writes a version that follows `over`; a Conflict, and nothing changed, where another one follows it already."""
        taken = [int(x) for x in self._names("versions") if x.isdigit()]
        number = max(taken, default=0) + 1
        if self._version() != over:
            raise Conflict("another version was published")
        base = f"{number}-{uuid.uuid4().hex}"
        placed = rows.select("id", "vector", "url", "metadata", "seq", "op", part_of(F.col("id"), self.partitions).alias("part"))
        placed.repartition(self.partitions, "part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(f"{self.path}/base/{base}")
        if self._version() != over:
            raise Conflict("another version was published")
        try:
            out = self._fs.create(self._path(f"versions/{number}"), False)
        except Exception as e:  # the file is there
            raise Conflict("another version was published") from e
        out.write(bytearray(f"{base} {commit} {last_id} {END}\n".encode()))
        out.close()

    def prune(self, keep: int = 2) -> None:
        """Deletes versions but the last `keep`, with the commits that the oldest of these has folded. Readers of older versions
        must be done."""
        numbers = sorted((int(x) for x in self._names("versions") if x.isdigit()), reverse=True)[:keep]
        kept = [self.spark.read.text(f"{self.path}/versions/{n}").first()["value"].split() for n in numbers]
        for folder in ("base", "graph"):
            for name in set(self._names(folder)) - {w[0] for w in kept}:
                self._fs.delete(self._path(f"{folder}/{name}"), True)
        for name in self._names("versions"):
            if not name.isdigit() or int(name) not in numbers:
                self._fs.delete(self._path(f"versions/{name}"), False)
        for n in self._commits(0):
            if n <= min(int(w[1]) for w in kept):
                self._fs.delete(self._path(f"changes/commit={n}"), True)

    def _commits(self, after: int) -> list[int]:
        found = [int(x.split("=")[1]) for x in self._names("changes") if x.startswith("commit=")]
        return sorted(n for n in found if n > after and self._fs.exists(self._path(f"changes/commit={n}/_SUCCESS")))

    def _base(self, version: Version) -> DataFrame:
        return self.spark.read.schema(BASE + ", part int").parquet(f"{self.path}/base/{version.base}")

    def base(self) -> DataFrame:
        """The rows of the current version."""
        return self._base(self._version()).where("op = 'PUT'").drop("seq", "op")

    def _pending(self, version: Version) -> DataFrame:
        paths = [f"{self.path}/changes/commit={n}" for n in self._commits(version.commit)]
        return self.spark.read.schema(CHANGES).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES)

    def changes(self) -> DataFrame:
        """Change rows that the base doesn't hold yet."""
        return self._pending(self._version())

    def _last(self, version: Version) -> DataFrame:
        """The last pending change of each id, where the base doesn't hold a later one."""
        last = overlay.latest(self._pending(version))
        later = self._base(version).select("id", F.col("seq").alias("__seq"))
        old = last.join(later, "id").where("__seq > seq").select("id")
        return last.join(old, "id", "left_anti")

    def _state(self, version: Version) -> DataFrame:
        """Of each id the last change, tombstones among them."""
        last, base = self._last(version), self._base(version).drop("part")
        return base.join(last.select("id"), "id", "left_anti").unionByName(last.select(*base.columns))

    def rows(self) -> DataFrame:
        """The live set."""
        return self._state(self._version()).where("op = 'PUT'").drop("seq", "op")

    def _last_seq(self) -> int:
        v = self._version()
        return max(df.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] for df in (self._base(v), self._pending(v)))

    # ------------------------------------------------------------------ writing

    def _append(self, changes: DataFrame) -> None:
        n = max([self._version().commit, *(int(x.split("=")[1]) for x in self._names("changes") if x.startswith("commit="))]) + 1
        changes.select("seq", "op", "id", "vector", "url", "metadata").write.parquet(f"{self.path}/changes/commit={n}")

    def _last_id(self, version: Version) -> int:
        return max(version.last_id, files.max_id(self._pending(version)))

    def next_id(self) -> int:
        """One above the largest id ever put since the last load; ids of deleted rows aren't given again."""
        return self._last_id(self._version()) + 1

    def add(self, vector: list[float], url: str, metadata: str | None = None) -> int:
        """K1."""
        if vector is None:
            raise ValidationError({"vector": "must not be null"})
        if url is None or not url.strip():
            raise ValidationError({"url": "must not be blank"})
        check_dimension(len(vector), self.dim)
        new = self.next_id()
        self._append(self.spark.createDataFrame([(self._last_seq() + 1, "PUT", new, [float(x) for x in vector], url, metadata)], CHANGES))
        return new

    def add_all(self, rows: DataFrame) -> None:
        """K2, K3: upsert (id, vector, url, metadata); a wrong dimension, or an id that comes twice, fails before anything is written."""
        wrong = rows.where(F.col("vector").isNull() | (F.size("vector") != self.dim)).select("id", F.size("vector").alias("n")).first()
        if wrong is not None:
            raise ValidationError({f"id {wrong['id']}": f"incorrect vector dimension: {wrong['n']}, required: {self.dim}"})
        twice = rows.groupBy("id").count().where("count > 1 OR id IS NULL").first()
        if twice is not None:
            raise ValidationError({f"id {twice['id']}": "must be given, and once only"})
        self._append(rows.select(F.lit(self._last_seq() + 1).cast("long").alias("seq"), F.lit("PUT").alias("op"), "id", "vector", "url", "metadata"))

    def delete(self, id_: int) -> None:
        """K4: idempotent."""
        self._check_id(id_)
        self._append(self.spark.createDataFrame([(self._last_seq() + 1, "DELETE", id_, None, None, None)], CHANGES))

    def clear(self) -> None:
        """K5: everything up to now is gone; the id counter goes on."""
        v = self._version()
        self._publish(self._no_rows(), v, max(self._commits(v.commit), default=v.commit), self._last_id(v))

    def load_csv(self, path: str) -> int:
        """Replaces everything; the id counter starts again from the largest id, which is returned."""
        rows = files.read_dataset(self.spark, path, self.dim).select("*", F.lit(0).cast("long").alias("seq"), F.lit("PUT").alias("op"))
        v = self._version()
        largest = files.max_id(rows)
        self._publish(rows, v, max(self._commits(v.commit), default=v.commit), largest)
        return largest

    def export_csv(self, path: str, single: bool = False) -> None:
        files.write_dataset(self.rows(), path, single)

    def compact(self, force: bool = False) -> bool:
        """Fold the change log into a new version when a partition is due. Works on a frozen view: commits that arrive
        meanwhile stay pending, and a version that another writer published meanwhile makes it a Conflict."""
        if not force and not self.partition_stats().where("due").limit(1).count():
            return False
        v = self._version()
        self._publish(self._state(v), v, max(self._commits(v.commit), default=v.commit), self._last_id(v))
        return True

    # ------------------------------------------------------------------ reading

    @staticmethod
    def _check_id(id_: int) -> None:
        if id_ <= 0:
            raise ValidationError({"id": "must be positive"})

    def get(self, id_: int) -> dict:
        """S3: pruned to the id's partition."""
        self._check_id(id_)
        v = self._version()
        base = self._base(v).where((F.col("part") == part_of(F.lit(id_).cast("long"), self.partitions)) & (F.col("id") == id_)).drop("part")
        both = base.withColumn("new", F.lit(0)).unionByName(self._pending(v).where(F.col("id") == id_).withColumn("new", F.lit(1)))
        row = overlay.latest(both, order=["seq", "new"]).where("op = 'PUT'").select("id", "vector", "url", "metadata").first()
        if row is None:
            raise NotFound(id_)
        return row.asDict()

    def get_all(self, ids: DataFrame) -> DataFrame:
        """Missing ids are silently absent."""
        return self.rows().join(ids.select("id").distinct(), "id")

    def reconcile(self, force: bool = False, **options) -> dict[str, list[int]]:
        """The graphs of the current version against its partitions. Graphs of partitions that are gone are dropped, missing
        ones (all, if forced) are built; the others stay."""
        v = self._version()
        folder = f"graph/{v.base}"
        owned = {r["part"] for r in self.base().select("part").distinct().collect()}  # at most `partitions` rows
        known = {int(x.split("=")[1]) for x in self._names(folder) if x.startswith("part=")}
        known = {p for p in known if self._fs.exists(self._path(f"{folder}/part={p}/done"))}
        dropped, built = known - owned, owned if force else owned - known
        for p in dropped | built:
            self._fs.delete(self._path(f"{folder}/part={p}"), True)
        if built:
            rows = self.base()
            pieces = max(1, -(-rows.count() // (self.partitions * search.CHUNK)))
            graphs = search.graph_index(rows.where(F.col("part").isin(sorted(built))), self.partitions, pieces=pieces, **options)
            graphs = graphs.withColumnRenamed("part", "piece").withColumn("part", F.pmod("piece", F.lit(self.partitions)))
            graphs.write.mode("append").partitionBy("part").parquet(f"{self.path}/{folder}")
            for p in built:
                self._fs.create(self._path(f"{folder}/part={p}/done"), True).close()
        return {"dropped": sorted(dropped), "built": sorted(built)}

    def build_index(self, **options) -> None:
        """The graphs of the current version. Searches with the graph engine use them; later changes are searched exactly
        until the next version is built."""
        self.reconcile(force=True, **options)

    rebuild = build_index

    def search(self, queries: DataFrame, k: int | None = None, engine: str = "exact", **options) -> DataFrame:
        """Base without tombstones and pending by the engine, pending exactly."""
        bad = queries.where(F.col("vector").isNull() | (F.size("vector") != self.dim)).select(F.size("vector").alias("n")).first()
        if bad is not None:
            check_dimension(bad["n"], self.dim)
        v = self._version()
        last = self._last(v)
        graphs = f"graph/{v.base}"
        if engine == "graph" and any(x.startswith("part=") for x in self._names(graphs)):
            k = check_count(k)
            index = self.spark.read.schema(search.GRAPH.replace("part int", "piece int") + ", part int").option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/{graphs}")
            pending = last.where("op = 'PUT'").select("id", "vector")
            found = [search.search_graph(index.drop("part").withColumnRenamed("piece", "part"), queries, k, exclude=last, **options), search.exact(pending, queries, k)]
            return search.hydrate(search.merge([f.drop("position") for f in found], k), self.rows(), k)
        base = search.without(self.base().drop("part"), last)
        pending = last.where("op = 'PUT'").select("id", "vector", "url", "metadata")
        return search.search(base, queries, k, engine, delta=pending, **options)

    def search_text(self, texts: DataFrame, k: int | None = None, model=None, **options) -> DataFrame:
        """§2.11: (query_id, text); blank texts are an error. The embedding is the stand-in unless a model is given."""
        return self.search(texts.select("query_id", embedder(model, self.dim)(F.col("text")).alias("vector")), k, **options)

    def search_image(self, images: DataFrame, k: int | None = None, model=None, **options) -> DataFrame:
        """§2.11, S12, S13: (query_id, content), e.g. of files.read_images or files.fetch_images."""
        return self.search(images.select("query_id", embedder(model, self.dim)(F.col("content")).alias("vector")), k, **options)

    def search_full(self, queries: DataFrame, k: int | None = None, registry: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """Rows and coverage; a registry (part, active) tells which partitions answer (X14), all do without one."""
        if registry is None:
            registry = self.partition_stats().select("part", F.lit(True).alias("active"))
        return self.search(queries, k, **options), stats.coverage(registry)

    def partition_stats(self) -> DataFrame:
        v = self._version()
        base = self.base()
        last = self._last(v).select("id", "op", "vector").withColumn("part", part_of(F.col("id"), self.partitions))
        met = last.join(base.select("id", F.col("vector").alias("stored")), "id", "left")
        # A put of the vector that the base has needs no upkeep of the index
        due = met.where("NOT (op = 'PUT' AND vector <=> stored)")
        return stats.partition_stats(base, due.where("op = 'PUT'"), due.where("stored IS NOT NULL"), self.dim)

    def stats(self) -> DataFrame:
        """§2.9: the cluster's sums with the version and the changes that aren't folded yet."""
        v = self._version()
        backlog = self._pending(v).agg(F.count("*").alias("backlog"))
        out = stats.cluster_stats(self.partition_stats()).join(F.broadcast(backlog))  # one row each
        return out.withColumn("version", F.lit(v.number)).withColumn("commits_folded", F.lit(v.commit))
