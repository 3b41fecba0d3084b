"""Spaces: directories of quads in snapshots and deltas with a manifest, and jobs that import and export them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.parser import Parser
from ..sources.rdf_files import read_rdf, write_rdf
from ..sources.store import DEFAULT_GRAPH, QUAD_SCHEMA, QuadStore
from . import derived as D
from .kgquery import VALUE_PROPERTIES
from .updates import changes

EDGE_SCHEMA = "edge string, source string, dest string, g string"
SLOT_SCHEMA = "frame string, slot string, slot_type string, property string, value string, g string"


#: Deltas after which a write compacts the space.
MOST_DELTAS = 8
#: Predicates whose counts steer join order; rarer ones count as unknown.
MOST_PREDICATES = 10_000
KEYS = ["s", "p", "o", "g"]
SLOT_PROPERTIES = [*VALUE_PROPERTIES.values(), D.SLOT_VALUE]


@dataclass
class Manifest:
    """``base`` names the snapshot and the tables derived from it, ``deltas`` the changes since, in order."""

    space: str
    version: int = 0
    base: int = 0
    deltas: list[int] = field(default_factory=list)
    graphs: list[str] = field(default_factory=list)
    namespaces: dict[str, str] = field(default_factory=dict)


class Space:
    """A named set of quads: a Parquet snapshot, small deltas of what was added and removed since, and
    tables of edges, slots and predicate counts that are kept in step with both.

    A write adds a delta and a manifest of the next version, which fails if another writer was first.
    After MOST_DELTAS deltas the space is compacted: a new snapshot is written and the old files go.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self._stores: dict[bool, tuple[int, QuadStore]] = {}

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    @property
    def base(self) -> str:
        return f"{self.root}/{self.name}"

    def _versions(self) -> list[int]:
        fs, path = self._fs(self.base)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self._versions())

    def create(self) -> Space:
        if self.exists():
            raise ValueError(f"space {self.name} exists")
        self._compacted(Manifest(self.name), self.spark.createDataFrame([], QUAD_SCHEMA))
        return self

    def drop(self) -> None:
        fs, path = self._fs(self.base)
        fs.delete(path, True)

    @staticmethod
    def list_spaces(spark: SparkSession, root: str) -> list[str]:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []

    def manifest(self) -> Manifest:
        rows = self.spark.read.text(f"{self.base}/manifest-{self._versions()[-1]}.json", wholetext=True).collect()
        return Manifest(**json.loads(rows[0].value))

    def _publish(self, m: Manifest) -> None:
        """Write the manifest of the version; the file must be new, so of two writers one fails."""
        fs, path = self._fs(f"{self.base}/manifest-{m.version}.json")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(asdict(m)).encode("utf-8")))
        out.close()

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def _net(self, m: Manifest) -> DataFrame | None:
        """(s, p, o, g, change): what the deltas add (1) to the snapshot and remove (-1) from it."""
        if not m.deltas:
            return None
        parts = [self._table(f"delta-{v}", f"{QUAD_SCHEMA}, change int") for v in m.deltas]
        # a delta holds effective changes alone, so the sum tells the state
        every = reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.sum("change").cast("int").alias("change"))
        return every.where("change <> 0")

    def quads(self, m: Manifest | None = None) -> DataFrame:
        m = m or self.manifest()
        old, net = self._table(f"quads-{m.base}", QUAD_SCHEMA), self._net(m)
        if net is None:
            return old
        return old.join(net.where("change < 0"), KEYS, "left_anti").select(KEYS).unionByName(net.where("change > 0").select(KEYS))

    def edges(self, m: Manifest | None = None) -> DataFrame:
        """The edge table: that of the snapshot, with the edge nodes that changed derived anew."""
        m = m or self.manifest()
        old, net = self._table(f"edges-{m.base}", EDGE_SCHEMA), self._net(m)
        if net is None:
            return old
        ends = [T.iri(D.EDGE_SOURCE), T.iri(D.EDGE_DEST)]
        touched = net.where(F.col("p").isin(*ends)).select(F.col("s").alias("edge"), "g").distinct()
        now = self.quads(m).where(F.col("p").isin(*ends)).join(touched.withColumnRenamed("edge", "s"), ["s", "g"], "left_semi")
        return old.join(touched, ["edge", "g"], "left_anti").select(old.columns).unionByName(D.edges(now))

    def slots(self, m: Manifest | None = None) -> DataFrame:
        """The slot table: that of the snapshot, with the slots that changed or whose edges did derived anew."""
        m = m or self.manifest()
        old, net = self._table(f"slots-{m.base}", SLOT_SCHEMA), self._net(m)
        if net is None:
            return old
        ends = [T.iri(D.EDGE_SOURCE), T.iri(D.EDGE_DEST)]
        edge = net.where(F.col("p").isin(*ends)).select(F.col("s").alias("edge"), "g").distinct()
        before = self._table(f"edges-{m.base}", EDGE_SCHEMA).join(edge, ["edge", "g"], "left_semi").select("dest", "g")
        every = self.edges(m)
        after = every.join(edge, ["edge", "g"], "left_semi").select("dest", "g")
        own = net.where(F.col("p").isin(T.iri(D.SLOT_TYPE), *map(T.iri, SLOT_PROPERTIES))).select(F.col("s").alias("dest"), "g")
        touched = before.unionByName(after).unionByName(own).distinct().withColumnRenamed("dest", "slot")
        quads = self.quads(m).join(touched.withColumnRenamed("slot", "s"), ["s", "g"], "left_semi").select(KEYS)
        now = D.slots(quads, SLOT_PROPERTIES, every.join(touched.withColumnRenamed("slot", "dest"), ["dest", "g"], "left_semi"))
        return old.join(touched, ["slot", "g"], "left_anti").select(old.columns).unionByName(now)

    def statistics(self, m: Manifest | None = None) -> DataFrame:
        """(predicate, quads), counted over snapshot and deltas."""
        m = m or self.manifest()
        old, net = self._table(f"statistics-{m.base}", "predicate string, quads long"), self._net(m)
        if net is None:
            return old
        both = old.unionByName(net.select(F.col("p").alias("predicate"), F.col("change").cast("long").alias("quads")))
        return both.groupBy("predicate").agg(F.sum("quads").alias("quads")).where("quads > 0")

    def store(self, statistics: bool = False) -> QuadStore:
        """The current version as a store; as long as there is no newer one, the same plans again."""
        version = self._versions()[-1]
        if self._stores.get(statistics, (None,))[0] != version:
            m = self.manifest()
            most = self.statistics(m).orderBy(F.desc("quads"), "predicate").limit(MOST_PREDICATES)
            stats = {r.predicate: r.quads for r in most.collect()} if statistics else None
            self._stores[statistics] = version, QuadStore(self.quads(m), stats, frozenset(m.graphs), {"edges": self.edges(m), "slots": self.slots(m)})
        return self._stores[statistics][1]

    def _compacted(self, m: Manifest, quads: DataFrame) -> None:
        """Write a snapshot with the tables derived from it, publish it, and delete what it replaces."""
        old = [*([f"{t}-{m.base}" for t in ("quads", "edges", "slots", "statistics")] if m.version else []), *(f"delta-{v}" for v in m.deltas)]
        m.version += 1
        n = m.version
        # rows of a predicate lie together, so a pattern's scan skips the other row groups
        quads.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.mode("overwrite").parquet(f"{self.base}/quads-{n}")
        fresh = self._table(f"quads-{n}", QUAD_SCHEMA)
        D.edges(fresh).write.mode("overwrite").parquet(f"{self.base}/edges-{n}")
        slots = D.slots(fresh, SLOT_PROPERTIES, self._table(f"edges-{n}", EDGE_SCHEMA))
        slots.repartitionByRange("slot_type", "property", "value").sortWithinPartitions("slot_type", "property", "value").write.mode("overwrite").parquet(f"{self.base}/slots-{n}")
        D.predicate_stats(fresh).write.mode("overwrite").parquet(f"{self.base}/statistics-{n}")
        m.base, m.deltas = n, []
        self._publish(m)
        for name in old:
            fs, path = self._fs(f"{self.base}/{name}")
            fs.delete(path, True)

    def compact(self) -> None:
        m = self.manifest()
        self._compacted(m, self.quads(m))

    def _change(self, m: Manifest, removed: DataFrame | None, added: DataFrame | None) -> Manifest:
        """The manifest with a delta of the changes that have an effect; what is added wins."""
        now, none = self.quads(m), self.spark.createDataFrame([], QUAD_SCHEMA)
        added = none if added is None else added.select(KEYS).distinct()
        removed = none if removed is None else removed.select(KEYS).distinct()
        # the changes are the smaller side, so they are what is broadcast, if anything is
        lost = now.join(removed.join(added, KEYS, "left_anti"), KEYS, "left_semi").select(*KEYS, F.lit(-1).alias("change"))
        new = added.join(now.join(added, KEYS, "left_semi"), KEYS, "left_anti").select(*KEYS, F.lit(1).alias("change"))
        version = m.version + 1
        lost.unionByName(new).write.mode("overwrite").parquet(f"{self.base}/delta-{version}")
        m.version, m.deltas = version, [*m.deltas, version]
        return m

    def _written(self, m: Manifest) -> None:
        if len(m.deltas) > MOST_DELTAS:
            self._compacted(m, self.quads(m))
        else:
            self._publish(m)

    def update(self, text: str) -> None:
        """Run ``;``-separated operations, a delta each, and publish them together."""
        m = self.manifest()
        for u in Parser(text, m.namespaces).update():
            removed, added, graphs = changes(self.quads(m), u, frozenset(m.graphs))
            m.graphs = sorted(graphs)
            if removed is not None or added is not None:
                m = self._change(m, removed, added)
        if m.version == self.manifest().version:
            m.version += 1
        self._written(m)

    def load(self, path: str, kind: str | None = None, graph: str | None = None, replace: bool = False) -> None:
        more = read_rdf(self.spark, path, kind, graph)
        if replace:
            self.replace(more)
        else:
            self._written(self._change(self.manifest(), None, more))

    def replace(self, quads: DataFrame) -> None:
        """Put other quads in place of all."""
        self._compacted(self.manifest(), quads.select(KEYS).dropDuplicates(KEYS))

    def add_namespace(self, prefix: str, iri: str) -> None:
        m = self.manifest()
        m.namespaces[prefix] = iri
        m.version += 1
        self._publish(m)

    def export(self, path: str, kind: str = "nquads", graph: str | None = None, limit: int | None = None) -> None:
        write_rdf(self.quads(), path, kind, graph, limit)

    def graph_counts(self) -> DataFrame:
        return self.quads().groupBy("g").agg(F.count("*").alias("quads"), F.count_distinct("s").alias("subjects"))

    def summary(self) -> DataFrame:
        q = self.quads()
        return q.agg(F.count("*").alias("quads"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct(F.when(F.col("g") != DEFAULT_GRAPH, F.col("g"))).alias("graphs"))


@dataclass
class Job:
    """An import or export with its life: created, running, completed or failed."""

    kind: str
    space: str
    path: str
    status: str = "created"
    started: str | None = None
    ended: str | None = None
    error: str | None = None

    def run(self, space: Space, **options) -> Job:
        now = lambda: datetime.now(timezone.utc).isoformat()
        self.status, self.started = "running", now()
        try:
            (space.load if self.kind == "import" else space.export)(self.path, **options)
            self.status = "completed"
        except Exception as e:  # the job records why it failed and the caller decides
            self.status, self.error = "failed", str(e)[:2000]
        self.ended = now()
        return self
