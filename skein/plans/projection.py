"""The relational tables seen as a graph, for running the operators at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut

TRUST = {"BUILDING": "untrusted_external", "MACHINERY": "semi_trusted_external"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, complexity: bool = True) -> DataFrame:
    """Regions are namespaces, nations modules, customers and suppliers classes, orders (cc: 1 + lines) and parts (cc: size) functions."""
    t = lambda name: table(spark, sf_dir, name)
    # What does not ask for complexity is spared the lines of orders, which would be counted all the same.
    if complexity:
        lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
        orders = t("orders").join(lines, "o_orderkey", "left")
    else:
        orders = t("orders").withColumn("n", F.lit(None).cast("long"))
    none = F.lit(None).cast("int")

    def part(df, kind, key, name, node_kind, cc, base):
        return df.select(_id(kind, key).alias("id"), F.col(name).cast("string").alias("name"), F.lit(node_kind).alias("kind"), F.lit("source").alias("origin"), cc.cast("int").alias("cc"), (F.lit(base << 40) + F.col(key)).cast("long").alias("node_seq"))

    out = part(t("region"), "region", "r_regionkey", "r_name", "namespace", none, 0)
    for more in (
        part(t("nation"), "nation", "n_nationkey", "n_name", "module", none, 1),
        part(t("customer"), "customer", "c_custkey", "c_name", "class", none, 2),
        part(t("supplier"), "supplier", "s_suppkey", "s_name", "class", none, 3),
        part(orders, "order", "o_orderkey", "o_orderkey", "function", 1 + F.coalesce("n", F.lit(0)) if complexity else none, 4),
        part(t("part"), "part", "p_partkey", "p_name", "function", F.col("p_size"), 5),
    ):
        out = out.unionByName(more)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, confidence): containment, ownership as calls, a call a line, reads and writes by line status."""
    t = lambda name: table(spark, sf_dir, name)
    sure = F.lit("certain")

    def part(df, src, dst, kind, confidence):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), confidence.alias("confidence"))

    lines = t("lineitem")
    grade = F.when(F.col("l_returnflag") == "A", "certain").when(F.col("l_returnflag") == "N", "inferred").otherwise("uncertain")
    order, item, supplier = _id("order", "l_orderkey"), _id("part", "l_partkey"), _id("supplier", "l_suppkey")
    out = part(t("nation"), _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains", sure)
    for more in (
        part(t("customer"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "contains", sure),
        part(t("supplier"), _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains", sure),
        part(t("orders"), _id("customer", "o_custkey"), _id("order", "o_orderkey"), "calls", sure),
        part(lines, order, item, "calls", grade),
        part(lines, item, supplier, "calls", grade),
        part(lines, order, item, F.when(F.col("l_linestatus") == "O", "reads").otherwise("writes"), sure),
    ):
        out = out.unionByName(more)
    return out


def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    trust = F.when(segment == "BUILDING", TRUST["BUILDING"]).when(segment == "MACHINERY", TRUST["MACHINERY"]).otherwise("trusted_internal")
    asset = F.when(F.col("c_acctbal") >= 5000, "high").when(F.col("c_acctbal") >= 0, "medium").otherwise("low")
    return table(spark, sf_dir, "customer").select(_id("customer", "c_custkey").alias("node_id"), F.lit("api").alias("kind"), trust.alias("trust_level"), asset.alias("asset_value"), segment.alias("description"))


def graph(spark: SparkSession, sf_dir: str, complexity: bool = True) -> GraphBundle:
    """The tables as a graph; without ``complexity`` orders have none."""
    found = edges(spark, sf_dir).withColumn("edge_seq", F.lit(0).cast("long"))
    return GraphBundle(spark, {"nodes": nodes(spark, sf_dir, complexity).withColumn("attrs", F.lit("{}")), "edges": found.withColumn("attrs", F.lit("{}")).withColumn("file_path", F.lit(None).cast("string")).withColumn("start_line", F.lit(None).cast("int")), "entrypoints": entrypoints(spark, sf_dir)})


def trade(spark: SparkSession, sf_dir: str) -> GraphBundle:
    """Nations that bought from nations early in 1995 (lines of 50 pieces or more): a small graph with cycles."""
    t = lambda name: table(spark, sf_dir, name)
    early = t("orders").where((F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1995-04-01"))
    sold = t("lineitem").where("l_quantity >= 50").join(early, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = sold.select(_id("nation", "c_nationkey").alias("src"), _id("nation", "s_nationkey").alias("dst"), F.lit("calls").alias("kind"), F.lit("certain").alias("confidence"), F.lit(0).cast("long").alias("edge_seq"))
    own = t("nation").select(_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("function").alias("kind"), F.lit("source").alias("origin"), (F.col("n_nationkey") % 7).cast("int").alias("cc"), F.col("n_nationkey").cast("long").alias("node_seq"))
    tags = t("nation").where("n_nationkey % 4 = 0").select(_id("nation", "n_nationkey").alias("node_id"), F.lit("api").alias("kind"), F.element_at(F.array(F.lit("untrusted_external"), F.lit("semi_trusted_external"), F.lit("trusted_internal")), (F.col("n_regionkey") % 3 + 1)).alias("trust_level"), F.lit("high").alias("asset_value"), F.lit("").alias("description"))
    return GraphBundle(spark, {"nodes": own, "edges": pairs, "entrypoints": tags})


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): event types that follow each other for a user."""
    from pyspark.sql import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): page urls and the targets of their hrefs, a row a link."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst"))


def web(spark: SparkSession, sf_dir: str) -> GraphBundle:
    """Pages as modules, links as calls: most targets are no pages."""
    found = cut(links(spark, sf_dir)).select("src", "dst", F.lit("calls").alias("kind"), F.lit("certain").alias("confidence"), F.monotonically_increasing_id().alias("edge_seq"), F.lit("{}").alias("attrs"))
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("id"), F.col("url").alias("name"), F.lit("module").alias("kind"), F.lit("source").alias("origin"), F.col("page_id").alias("node_seq"), F.lit("{}").alias("attrs")).dropDuplicates(["id"])
    return GraphBundle(spark, {"nodes": pages, "edges": found})


def address_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end): documents laid end to end by id.

    The running sum goes over blocks of ids first, so that no task orders them all.
    """
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 4096).alias("block"))
    before = docs.groupBy("block").agg(F.sum("n_chars").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    within = F.sum("n_chars").over(Window.partitionBy("block").orderBy("doc_id"))
    placed = docs.withColumn("upto", within).join(before, "block")
    return placed.select("doc_id", (F.col("before") + F.col("upto") - F.col("n_chars")).alias("start"), (F.col("before") + F.col("upto")).alias("end"))
