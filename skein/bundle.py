"""A graph as a bundle of tables, with storing, loading and merging."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import SCHEMAS


@dataclass(frozen=True)
class GraphBundle:
    """The tables of :data:`skein.schema.SCHEMAS` by name; those left out are empty.

    Tables are immutable: an operator that changes the graph gives a new bundle.
    """

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self.tables:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]

    def having(self, **tables: DataFrame) -> GraphBundle:
        return replace(self, tables=self.tables | tables)

    def materialised(self) -> GraphBundle:
        """All tables checkpointed, so that queries begin from files and not from what built the graph."""
        from .functions.storage import cut

        return replace(self, tables={name: cut(df) for name, df in self.tables.items()})

    @staticmethod
    def conform(df: DataFrame, name: str) -> DataFrame:
        """``df`` with all columns of the table, missing ones null."""
        wanted = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

    def save(self, path: str) -> None:
        """Parquet, a folder a table; edges are partitioned by kind, so that a projection reads its kinds only."""
        for name, df in self.tables.items():
            out = self.conform(df, name).write.mode("overwrite")
            (out.partitionBy("kind") if name == "edges" else out).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphBundle:
        found = {}
        for name in SCHEMAS:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                found[name] = cls.conform(spark.read.parquet(f"{path}/{name}"), name)
        return cls(spark, found)

    def merge(self, other: GraphBundle, apart: bool = False) -> GraphBundle:
        """Nodes, tags and evidence: the later wins. Edges, diagnostics and annotations append; subgraphs unite; dependencies keep their first order.

        With ``apart``, as for graphs of different languages, a node id that both have is an error unless both are proxies.
        """
        if apart:
            own = lambda g, name: self.conform(g.nodes, "nodes").select("id", F.col("kind").alias(name), F.col("language").alias(f"{name}_language"))
            both = own(self, "one").join(own(other, "two"), "id").where("one <> 'proxy' or two <> 'proxy'").orderBy("id").first()
            if both is not None:
                raise ValueError(f"node id {both['id']} is in both graphs ({both['one_language']} and {both['two_language']}); parse them apart or rename the modules")
        out = {name: last_wins(getattr(self, name), getattr(other, name), key) for name, key in (("nodes", "id"), ("entrypoints", "node_id"), ("evidence", "evidence_id"), ("binary_artifacts", "id"))}
        clash = self.binary_artifacts.select("id", F.col("sha256").alias("x")).join(other.binary_artifacts.select("id", F.col("sha256").alias("y")), "id").where(~F.col("x").eqNullSafe(F.col("y")))
        if clash.limit(1).count():
            raise ValueError(f"binary artifacts of one id differ: {clash.first()['id']}")
        for name, seq in (("edges", "edge_seq"), ("annotations", "seq")):
            mine, theirs = self.conform(getattr(self, name), name), self.conform(getattr(other, name), name)
            shift = (mine.agg(F.max(seq)).first()[0] or 0) + 1
            out[name] = mine.unionByName(theirs.withColumn(seq, F.col(seq) + shift))
        for name in ("diagnostics", "source_files", "binary_ranges", "binary_mappings", "type_refs"):
            out[name] = self.conform(getattr(self, name), name).unionByName(self.conform(getattr(other, name), name))
        out["subgraphs"] = self.subgraphs.unionByName(other.subgraphs).distinct()
        both = self.dependencies.withColumn("side", F.lit(0)).unionByName(other.dependencies.withColumn("side", F.lit(1)))
        shift = (self.dependencies.agg(F.max("seq")).first()[0] or 0) + 1
        out["dependencies"] = both.groupBy("name").agg(F.min(F.struct("side", "seq")).alias("at")).select((F.col("at.side") * F.lit(shift) + F.col("at.seq")).alias("seq"), "name")
        return GraphBundle(self.spark, out)

    def namespaced(self, root: str) -> GraphBundle:
        """All ids with ``root::`` before them, for graphs of several roots."""
        columns = {"nodes": ["id"], "edges": ["src", "dst"], "annotations": ["node_id"], "entrypoints": ["node_id"], "evidence": ["node_id", "source_id"], "subgraphs": ["node_id"], "type_refs": ["node_id"], "binary_ranges": ["node_id"], "binary_mappings": ["node_id"]}
        out = dict(self.tables)
        for name, ids in columns.items():
            if name in out:
                out[name] = out[name].withColumns({c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{root}::"), F.col(c))) for c in ids})
        return replace(self, tables=out)


def last_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row a key: that of ``second`` where both have it, of several in one table the last in order."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    seq = [F.col(c) for c in ("node_seq",) if c in both.columns]
    order = Window.partitionBy(key).orderBy(F.desc("__side"), *[c.desc_nulls_last() for c in seq])
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__side")
