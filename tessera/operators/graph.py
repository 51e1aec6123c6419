"""Breadth-first search, PageRank and components over adjacency lists; one join for each step, lineage cut between steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, discard, written

#: Links that one task may join: some tens of bytes each.
FEW = 200_000
#: Steps after which the frontiers of a search are written as one table.
MERGED = 8


def parse_adjacency(lines: DataFrame, line: str = "line") -> DataFrame:
    """(id, adj) from lines ``id neighbour neighbour ...``; a lone id has no out-links. Blank lines are skipped."""
    parts = F.split(F.trim(F.col(line)), r"\s+").cast("array<int>")
    kept = lines.where(F.trim(F.col(line)) != "").select(parts.alias("p"))
    return kept.select(F.col("p")[0].alias("id"), F.slice("p", F.lit(2), F.size("p")).alias("adj"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, adj) from (src, dst); every end of an edge becomes a node."""
    ends = edges.select(F.col("src").alias("id"), "dst").unionByName(edges.select(F.col("dst").alias("id"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")))
    return ends.groupBy("id").agg(F.array_sort(F.collect_list("dst")).alias("adj"))


def graph_stats(nodes: DataFrame) -> DataFrame:
    """(nodes, edges, dangling)."""
    return nodes.agg(F.count("*").alias("nodes"), F.sum(F.size("adj")).cast("bigint").alias("edges"), F.count_if(F.size("adj") == 0).alias("dangling"))


def observed(observation: Observation, name: str) -> float | int:
    """An observed number; 0 where adaptive execution has dropped the part of the plan that it watched, for that turned out empty."""
    try:
        return observation.get[name] or 0
    except Py4JJavaError:
        return 0


def links_of(nodes: DataFrame) -> DataFrame:
    """(src, dst): a row for each link, so that a node of very many neighbours is very many rows and not a very long one."""
    return nodes.select(F.col("id").alias("src"), F.explode("adj").alias("dst"))


def bfs_links(links: DataFrame, ids: DataFrame, source: int, steps: int | None = None, log: list[dict] | None = None) -> DataFrame:
    """(id, dist) of the ids that the source reaches. Links to ids that aren't in ``ids`` are dropped, once and for all.

    Each step sends only from the last frontier, so all steps together use each link once; the loop ends with an empty one. A step's
    numbers are observed in the job that writes its frontier; ``log`` gets those of steps that find something: step, frontier, reached, and
    sent, the links followed.
    """
    ids = written(ids.select("id").distinct(), "ids")
    links = written(links.select("src", "dst").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "links")
    frontier = written(ids.where(F.col("id") == source).select("id", F.lit(0).alias("dist")), "frontier")
    if frontier.isEmpty():
        raise ValueError(f"no node {source}")
    seen, reached, step = frontier, 1, 0
    if log is not None:
        log.append({"step": 0, "frontier": 1, "reached": 1, "sent": 0})
    while steps is None or step < steps:
        step += 1
        of_links, of_ids = Observation(), Observation()
        sent = links.join(frontier.select(F.col("id").alias("src")), "src").observe(of_links, F.count(F.lit(1)).alias("n")).select(F.col("dst").alias("id")).distinct()
        new = sent.join(seen.select("id"), "id", "left_anti").select("id", F.lit(step).alias("dist")).observe(of_ids, F.count(F.lit(1)).alias("n"))
        frontier = written(new, "frontier")
        found = observed(of_ids, "n")
        if not found:
            break
        reached += found
        if log is not None:
            log.append({"step": step, "frontier": found, "reached": reached, "sent": observed(of_links, "n")})
        seen = seen.unionByName(frontier)
        if step % MERGED == 0:
            seen = written(seen, "seen")
    return seen


def bfs(nodes: DataFrame, source: int, steps: int | None = None, log: list[dict] | None = None) -> DataFrame:
    """(id, dist, adj): dist null where the source does not reach."""
    return nodes.select("id", "adj").join(bfs_links(links_of(nodes), nodes, source, steps, log), "id", "left").select("id", "dist", "adj")


def reachable(state: DataFrame) -> DataFrame:
    return state.where(F.col("dist").isNotNull())


def running_total(sizes: DataFrame) -> DataFrame:
    """(dist, n, reached) from (dist, n): a row for each distance, so few that one task may order them."""
    return sizes.withColumn("reached", F.sum("n").over(Window.orderBy("dist")))


def at_distance(state: DataFrame, d: int) -> DataFrame:
    return state.where(F.col("dist") == d)


def store_structure(nodes: DataFrame, path: str, buckets: int) -> DataFrame:
    """Writes nodes as a table bucketed and sorted by id, one file for each bucket, and opens it; later sessions open it again."""
    name = f"tessera_structure_{uuid.uuid4().hex}"
    nodes.select("id", "adj").repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    nodes.sparkSession.sql(f"drop table {name}")  # the files stay: it is an external table
    return open_structure(nodes.sparkSession, path, buckets, nodes.schema["id"].dataType.simpleString())


def open_structure(spark: SparkSession, path: str, buckets: int, kind: str = "int") -> DataFrame:
    """(id, adj) of ``store_structure``: joins by id neither move nor sort it.

    The session is told to trust the order of a bucket's only file.
    """
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    name = f"tessera_structure_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} (id {kind}, adj array<{kind}>) using parquet clustered by (id) sorted by (id) into {int(buckets)} buckets location '{path}'")
    return spark.table(name)


def pagerank_messages(structure: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, m): what every node of the structure receives in a step."""
    sent = structure.join(ranks, "id").where(F.size("adj") > 0).select(F.explode("adj").alias("id"), (F.col("p") / F.size("adj")).alias("m"))
    return structure.select("id").join(sent.groupBy("id").agg(F.sum("m").alias("m")), "id", "left").select("id", F.coalesce("m", F.lit(0.0)).alias("m"))


def pagerank(
    nodes: DataFrame,
    steps: int | None = None,
    alpha: float = 0.15,
    n: int | None = None,
    source: int | None = None,
    tolerance: float | None = None,
    keep: str | None = None,
    first: int = 0,
    copartitioned: bool = True,
    log: list[dict] | None = None,
    most: int = 1000,
) -> DataFrame:
    """(id, p) after ``steps`` steps, or when a step changes the ranks by less than ``tolerance`` in all, ``most`` steps at most; Σp = 1.

    Mass of dangling nodes and of links to ids without a row goes, in equal parts, to all nodes; with ``source`` that mass and
    the random jump go to this node alone. ``copartitioned`` keeps the structure partitioned by id, so that a step moves
    only the messages; nodes from ``open_structure`` are so on disk, and need it not. ``keep`` is a folder for the ranks after each step;
    with ``first`` the work goes on from that step's ranks. The mass that arrives is observed in the job that makes a step's ranks; ``log``
    gets step, active (nodes that receive something), and lost, the mass that didn't arrive.
    """
    if steps is None and tolerance is None:
        raise ValueError("steps or a tolerance are needed")
    structure = nodes.repartition("id").persist(StorageLevel.MEMORY_AND_DISK) if copartitioned else nodes
    n = structure.count() if n is None else n
    if n <= 0:
        raise ValueError("a graph needs nodes")
    prior: Column = F.lit(1.0 / n) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    kind = nodes.schema["id"].dataType.simpleString()
    ranks = nodes.sparkSession.read.schema(f"id {kind}, p double").parquet(rank_path(keep, first)) if first else structure.select("id", prior.alias("p"))
    step = first
    while step < (most + first if steps is None else steps):
        seen = Observation()
        got = cut(pagerank_messages(structure, ranks).observe(seen, F.sum("m").alias("mass"), F.count_if(F.col("m") > 0).alias("active")))
        missing = max(0.0, 1.0 - observed(seen, "mass"))
        before, ranks = ranks, got.select("id", (alpha * prior + (1 - alpha) * (F.col("m") + missing * prior)).alias("p"))
        step += 1
        if log is not None:
            log.append({"step": step, "active": observed(seen, "active"), "lost": missing})
        if keep:
            ranks.write.mode("overwrite").parquet(rank_path(keep, step))
        if tolerance is not None and ranks.join(before.withColumnRenamed("p", "q"), "id").agg(F.sum(F.abs(F.col("p") - F.col("q")))).first()[0] < tolerance:
            break
    if copartitioned:
        structure.unpersist()
    return ranks


def rank_path(keep: str, step: int) -> str:
    """Where the ranks after a step are kept."""
    return f"{keep}/step-{step:04d}"


def _joined(links: DataFrame) -> DataFrame:
    """(u, v): each linked id and the smallest id that links reach, by union-find in one task; for few links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                a, c = root(u), root(v)
                up[max(a, c)] = min(a, c)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x in ([*up], map(root, [*up]))], ["u", "v"])

    kind = pa.int32() if links.schema["u"].dataType.simpleString() == "int" else pa.int64()
    return links.coalesce(1).mapInArrow(run, links.schema)


def components(edges: DataFrame, vertices: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """(id, comp): comp is the smallest id that links reach, direction ignored.

    Up to ``few`` distinct links are joined in one task. Beyond, alternating star contraction: each round rewires neighbours to the
    smallest neighbour, which ends after a number of rounds that grows with the logarithm of the longest chain. A vertex of very high
    degree costs no more in one task than others: minima are pre-aggregated, and the join that spreads them is a plain equi-join that
    adaptive execution splits. A round's tables go when the next one's are written.
    """
    links = written(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    rows = links.count()
    while rows > few:
        before, rows_before = links, rows
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        seen = Observation()
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = written(small.observe(seen, F.count(F.lit(1)).alias("n")), "small-stars")
        rows = observed(seen, "n")
        if rows == rows_before and links.join(before, ["u", "v"], "left_anti").isEmpty():  # no row has changed
            break
        discard(before, large)
    else:
        links = written(_joined(links), "joined")
    found = links.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    if vertices is None:
        vertices = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).where("id is not null").distinct()
    return vertices.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def component_counts(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(components, vertices, edges) from (id, comp) and (src, dst)."""
    of_labels = labels.agg(F.count_distinct("comp").alias("components"), F.count("*").alias("vertices"))
    return of_labels.join(edges.agg(F.count("*").alias("edges")))


def adjacency_lines(nodes: DataFrame) -> DataFrame:
    """(line) ``id neighbour neighbour ...``, as ``parse_adjacency`` reads it."""
    return nodes.select(F.concat_ws(" ", F.col("id").cast("string"), F.col("adj").cast("array<string>")).alias("line"))


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes with all their columns, to be read by ``read_nodes``."""
    nodes.write.mode("overwrite").parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def range_partition(nodes: DataFrame, parts: int, n: int, key: str = "id") -> DataFrame:
    """Nodes with the number of their range partition: ids 0..n-1 in ``parts`` equal ranges."""
    return nodes.withColumn("part", (F.floor(F.col(key) / F.lit(float(n)) * parts) % parts).cast("int"))


def partition_graph(nodes: DataFrame, parts: int, n: int | None = None, by_range: bool = False, key: str = "id") -> DataFrame:
    """The same nodes, dealt to ``parts`` partitions by hash or by range."""
    if by_range:
        if not n:
            raise ValueError("ranges need the number of nodes")
        return range_partition(nodes, parts, n, key).repartitionById(parts, "part").drop("part")
    return nodes.repartition(parts, key)


def node_text(nodes: DataFrame, value: str, digits: int | None = None) -> DataFrame:
    """(id, txt): ``{id value [first ten neighbours]}``, the value with so many ``digits`` after the point if they are given."""
    some = F.concat_ws(", ", F.slice("adj", 1, 10).cast("array<string>"))
    said = F.col(value).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.col(value).cast("double"))
    return nodes.select("id", F.format_string("{%d %s [%s]}", F.col("id"), said, some).alias("txt"))


def rank_lines(ranks: DataFrame, value: str, digits: int = 5) -> DataFrame:
    """(id, line): id, tab, value with so many ``digits`` after the point."""
    return ranks.select("id", F.format_string(f"%d\t%.{digits}f", F.col("id"), F.col(value).cast("double")).alias("line"))
