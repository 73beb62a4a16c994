"""The patient-drug graph: nodes, edges, degree, co-occurrence, propagation, components, pooling, layout aggregates."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .names import counted_ids, linked

def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration: written to spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of ours, on a single machine only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def dense_index(rows: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """0-based positions in a total order without bringing all rows into one task: range-partitioned, counted by partition,
    numbered within. One row a partition is gathered."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_base") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_base")


def has_other(named: DataFrame, dictionary: DataFrame, unknown: DataFrame) -> bool:
    """Whether any name is neither mapped nor among the frequent unknown ones."""
    known = dictionary.where("dc_id > 0").select("faers_raw").unionByName(unknown.select("faers_raw")).distinct()
    return not named.select("faers_raw").distinct().join(known, "faers_raw", "left_anti").isEmpty()


def drug_nodes(mapped: DataFrame, unknown: DataFrame, has_other: bool = True) -> DataFrame:
    """(node_index, semantic_id, node_label, node_kind): mapped ids, then frequent unknown names, then OTHER if asked for."""
    top = mapped.agg(F.max("dc_id")).scalar()
    rows = mapped.select(F.lit(0).alias("kind"), F.col("dc_id").alias("semantic_id"), F.concat(F.lit("DC:"), F.col("dc_id")).alias("node_label"), F.lit("mapped").alias("node_kind"))
    rows = rows.unionByName(unknown.select(F.lit(1).alias("kind"), (F.coalesce(top, F.lit(0)) + F.col("rank")).cast("bigint").alias("semantic_id"), F.col("faers_raw").alias("node_label"), F.lit("frequent_unknown").alias("node_kind")))
    if has_other:
        rows = rows.unionByName(mapped.sparkSession.range(1).select(F.lit(2).alias("kind"), F.lit(-1).cast("bigint").alias("semantic_id"), F.lit("OTHER").alias("node_label"), F.lit("other").alias("node_kind")))
    # nodes are drugs: some thousands
    return rows.withColumn("node_index", (F.row_number().over(Window.orderBy("kind", "semantic_id")) - 1).cast("bigint")).drop("kind")


def graph_edges(named: DataFrame, dictionary: DataFrame, unknown: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (patient_index, node_index): known names by id, frequent unknown ones by rank, the rest to OTHER."""
    other = nodes.where("semantic_id = -1").agg(F.collect_set("node_index")).first()[0]
    return linked(named, "patient_index", node_pairs(dictionary, unknown, nodes), "node_index", other)


def node_counts(named: DataFrame, dictionary: DataFrame, unknown: DataFrame, nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """(node_index, a, b): serious and other patients of each node by the edges of graph_edges, which aren't made for it.
    reports: (patient_index, is_serious)."""
    other = nodes.where("semantic_id = -1").agg(F.collect_set("node_index")).first()[0]
    return counted_ids(named.withColumnRenamed("patient_index", "report"), reports.withColumnRenamed("patient_index", "report"), node_pairs(dictionary, unknown, nodes), "node_index", other)


def node_pairs(dictionary: DataFrame, unknown: DataFrame, nodes: DataFrame) -> DataFrame:
    """(faers_raw, node_index) of known and frequent unknown names; a known name whose id has no node has null, as it is no
    OTHER."""
    mapped = dictionary.where("dc_id > 0").select("faers_raw", F.col("dc_id").alias("semantic_id"))
    labels = unknown.select("faers_raw").join(nodes.where("node_kind = 'frequent_unknown'").select(F.col("node_label").alias("faers_raw"), "semantic_id"), "faers_raw")
    pairs = mapped.unionByName(labels.join(mapped.select("faers_raw").distinct(), "faers_raw", "left_anti"))
    return pairs.join(nodes.select("semantic_id", "node_index"), "semantic_id", "left").select("faers_raw", "node_index")


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("node_index").agg(F.count(F.lit(1)).alias("degree"))


def cooccurrence(edges: DataFrame) -> DataFrame:
    """(n1, n2, weight) in both directions: patients with both drugs. A patient has few drugs."""
    e = edges.distinct()
    pairs = e.select("patient_index", F.col("node_index").alias("n1")).join(e.select("patient_index", F.col("node_index").alias("n2")), "patient_index").where("n1 <> n2")
    return pairs.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("weight"))


def neighbour_mean(weights: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Weighted mean of the neighbours' values, 0 without neighbours."""
    means = weights.join(values.select(F.col("node_index").alias("n2"), value), "n2").groupBy("n1").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("_m"))
    return values.select("node_index").join(means.withColumnRenamed("n1", "node_index"), "node_index", "left").select("node_index", F.coalesce("_m", F.lit(0.0)).alias(f"neighbour_{value}"))


def propagated(weights: DataFrame, start: DataFrame, value: str, steps: int = 3, alpha: float = 0.7) -> DataFrame:
    """r <- alpha r + (1 - alpha) W r / rowsum, a checkpoint a step."""
    rows = start
    for _ in range(steps):
        means = neighbour_mean(weights, rows, value)
        rows = checkpointed(rows.join(means, "node_index").select("node_index", (alpha * F.col(value) + (1 - alpha) * F.col(f"neighbour_{value}")).alias(value)))
    return rows


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_index, component): smallest index reachable. Labels take their neighbours' least and then jump to the label's
    own label; the loop ends when no label changes."""
    labels = checkpointed(nodes.select("node_index", F.col("node_index").alias("component")))
    while True:
        near = links.select("n1", "n2").join(labels.withColumnRenamed("node_index", "n2"), "n2").groupBy("n1").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("n1", "node_index"), "node_index", "left").select("node_index", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.select(F.col("node_index").alias("component"), F.col("component").alias("further"))
        after = checkpointed(step.join(jump, "component", "left").select("node_index", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "before"), "node_index").where("component <> before")
        if changed.isEmpty():
            return after
        labels = after


#: Nodes up to which their values go to every task.
BROADCAST_NODES = 400_000


def pooled(edges: DataFrame, patients: DataFrame, values: DataFrame, names: list[str], parts: int | None = None) -> DataFrame:
    """Mean and maximum of the drugs' values for each patient; 0 without drugs. Edges stay as they are dealt where the values go
    to every task, else they are dealt by patient before they are grouped, so that no task holds more patients than its share."""
    from .ranges import dealt

    values = checkpointed(values)
    small = values.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    met = edges.join(F.broadcast(values), "node_index") if small else dealt(edges.join(values, "node_index"), "patient_index", parts)
    agg = met.groupBy("patient_index").agg(*[f(n).alias(f"{n}_{tag}") for n in names for tag, f in (("mean", F.avg), ("max", F.max))])
    return patients.select("patient_index").join(agg, "patient_index", "left").fillna(0)


def graph_features(edges: DataFrame, patients: DataFrame, nodes: DataFrame, steps: int = 3, alpha: float = 0.7, parts: int | None = None) -> DataFrame:
    """Eight columns a patient: neighbour risk, propagated risk, component risk and degree, each as mean and maximum. patients: patient_index,
    split, is_serious; nodes: node_index, log_ror. Statistics come from training edges."""
    train = edges.join(patients.where("split = 'train'").select("patient_index", "is_serious"), "patient_index")
    weights = checkpointed(cooccurrence(train.select("patient_index", "node_index")))
    seen = train.groupBy("node_index").agg(F.avg("is_serious").alias("risk"), F.count(F.lit(1)).alias("degree"))
    # a row a node, read many times below
    base = checkpointed(nodes.select("node_index", "log_ror").join(seen, "node_index", "left").fillna({"risk": 0.0, "degree": 0}))
    near = neighbour_mean(weights, base, "log_ror")
    spread = propagated(weights, base.select("node_index", "risk"), "risk", steps, alpha).withColumnRenamed("risk", "propagated")
    part = components(base, weights)
    by_part = part.join(base, "node_index").groupBy("component").agg(F.avg("risk").alias("component_risk"))
    values = base.select("node_index", "degree").join(near, "node_index").join(spread, "node_index").join(part.join(by_part, "component").select("node_index", "component_risk"), "node_index")
    return pooled(edges, patients, values, ["neighbour_log_ror", "propagated", "component_risk", "degree"], parts)


def rotated(edges: DataFrame, nodes: int, seed: int, split_no: int) -> DataFrame:
    """Ablation: drug ends moved by one shift a split, which keeps degrees of patients."""
    shift = 1 + ((seed * 1000003 + split_no * 97) % max(nodes - 1, 1))
    return edges.withColumn("node_index", F.pmod(F.col("node_index") + shift, F.lit(nodes)))


def systematic_sample(rows: DataFrame, label: str, key: str, each: int) -> DataFrame:
    """At most `each` rows of every label, at even distances in key order."""
    from .ranges import running

    ranked = running(rows.withColumn("_one", F.lit(1)), [F.asc(key)], {"_end": "_one"}, by=label)
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))  # a row a label
    slot = lambda k: F.floor(k * each / F.col("_n"))
    ranked = ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label")))
    return ranked.where((F.col("_n") <= each) | (slot(F.col("_end")) > slot(F.col("_end") - 1))).select(*rows.columns)


def primary_drug(edges: DataFrame, patients: DataFrame, none: int) -> DataFrame:
    """Each patient's drug of highest degree, the lowest index among equals; `none` without drugs."""
    best = edges.join(degree(edges), "node_index").groupBy("patient_index").agg(F.max_by("node_index", F.struct("degree", -F.col("node_index"))).alias("bucket"))
    return patients.select("patient_index").join(best, "patient_index", "left").select("patient_index", F.coalesce("bucket", F.lit(none).cast("bigint")).alias("bucket"))


def layout(patients: DataFrame, nodes: DataFrame, radius: float = 1.0) -> DataFrame:
    """Golden-angle discs: (kind, index, x, y)."""
    turn = 2.399963229728653
    disc = lambda df, c, kind, scale: df.select(F.lit(kind).alias("kind"), F.col(c).alias("index"), (scale * F.sqrt(F.col(c) + 0.5) * F.cos(turn * F.col(c))).alias("x"), (scale * F.sqrt(F.col(c) + 0.5) * F.sin(turn * F.col(c))).alias("y"))
    return disc(patients, "patient_index", "patient", radius).unionByName(disc(nodes, "node_index", "drug", radius * 2))


def grid_cells(points: DataFrame, cells: int = 4) -> DataFrame:
    """Counts, label sums and bounding boxes on an even grid over the points' bounds (one row)."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    place = lambda c, lo, hi: F.least(F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(lo)) * cells, F.col(hi) - F.col(lo)), F.lit(0.0))), F.lit(cells - 1)).cast("int")
    put = points.crossJoin(F.broadcast(box)).withColumns({"cx": place("x", "x0", "x1"), "cy": place("y", "y0", "y1")})
    return put.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def top_per_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


SPLIT_IDS = {"train": 0, "validation": 1, "test": 2}


def split_id(split: Column) -> Column:
    """0, 1, 2 for train, validation, test; -1 for anything else."""
    return F.coalesce(*[F.when(split == s, F.lit(k)) for s, k in SPLIT_IDS.items()], F.lit(-1))


def ordered_edges(edges: DataFrame, patients: DataFrame, parts: int | None = None) -> DataFrame:
    """(split_id, patient_index, node_index) in that order over all files: dealt by ranges, sorted within."""
    order = ["split_id", "patient_index", "node_index"]
    rows = edges.join(patients.select("patient_index", split_id(F.col("split")).alias("split_id")), "patient_index").select(*order)
    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def split_offsets(edges: DataFrame) -> DataFrame:
    """(split_id, edges, first): number of edges and place of the first one, a row a split. Each split must have some."""
    from .quality import AuditError

    n = {r["split_id"]: r["n"] for r in edges.groupBy("split_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(n) != set(SPLIT_IDS.values()):
        raise AuditError(f"edges by split are {n}")
    rows, first = [], 0
    for k in sorted(n):
        rows.append((k, n[k], first))
        first += n[k]
    return edges.sparkSession.createDataFrame(rows, "split_id int, edges long, first long")


def one_hop_means(edges: DataFrame, patients: DataFrame, nodes: DataFrame, width: int, features: str = "features") -> DataFrame:
    """(patient_index, neighbours): the mean of the drugs' vectors, component by component. A patient without drugs fails
    the job: such a graph can't be trained on."""
    from .quality import require_no_orphans

    require_no_orphans(patients, edges, "patient_index")
    means = edges.join(nodes.select("node_index", features), "node_index").groupBy("patient_index").agg(*[F.avg(F.col(features)[k]).alias(f"_m{k}") for k in range(width)])
    return patients.select("patient_index").join(means, "patient_index").select("patient_index", F.array(*[F.col(f"_m{k}") for k in range(width)]).alias("neighbours"))


def inductive_audit(edges: DataFrame, patients: DataFrame, message_edges: DataFrame | None = None) -> dict[str, int]:
    """Counts by split after checks: every patient in exactly one split, every edge's patient known, indexes dense, and the
    edges that messages are learnt from of training patients only."""
    from .quality import AuditError, require_no_orphans, require_splits, require_unique

    counts = require_splits(patients)
    require_unique(patients, ["patient_index"])
    require_no_orphans(edges, patients, "patient_index")
    n = sum(counts.values())
    lo, hi = patients.agg(F.min("patient_index"), F.max("patient_index")).first()
    if (lo, hi) != (0, n - 1):
        raise AuditError(f"patient indexes run from {lo} to {hi}, there are {n}")
    used = message_edges if message_edges is not None else edges.join(patients.where("split = 'train'").select("patient_index"), "patient_index", "left_semi")
    if not used.join(patients.where("split <> 'train'").select("patient_index"), "patient_index", "left_semi").isEmpty():
        raise AuditError("messages are learnt from edges of held-out patients")
    return counts


def cluster_drug_edges(edges: DataFrame, clusters: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, node_index, weight): the k drugs with most edges of each cluster's patients; clusters: patient_index, cluster."""
    weights = edges.join(clusters, "patient_index").groupBy("cluster", "node_index").agg(F.count(F.lit(1)).alias("weight"))
    return top_per_group(weights, "cluster", [F.desc("weight"), F.asc("node_index")], k)


def named_nodes(nodes: DataFrame, structures: DataFrame) -> DataFrame:
    """Nodes with the name to show: the structure's, else the node's own label. structures: id, name."""
    names = structures.groupBy(F.col("id").cast("bigint").alias("semantic_id")).agg(F.min("name").alias("_name"))
    return nodes.join(names, "semantic_id", "left").withColumn("display_name", F.coalesce(F.when(F.col("node_kind") == "mapped", F.col("_name")), F.col("node_label"))).drop("_name")


def clustered(points: DataFrame, cells: int = 4, clusters: int = 4) -> DataFrame:
    """points with cx, cy and a cluster: each cell of the even grid is cut at the median of x and each half at its median of
    y, so at most cells * cells * clusters clusters. Medians are exact (one row a cell)."""
    from .ranges import quantiles

    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    place = lambda c, lo, hi: F.least(F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(lo)) * cells, F.col(hi) - F.col(lo)), F.lit(0.0))), F.lit(cells - 1)).cast("int")
    put = points.crossJoin(F.broadcast(box)).withColumns({"cx": place("x", "x0", "x1"), "cy": place("y", "y0", "y1")}).drop("x0", "x1", "y0", "y1")
    if clusters < 2:
        return put.withColumn("cluster", (F.col("cx") * cells + F.col("cy")).cast("int"))
    across = quantiles(put, "x", [0.5], ["cx", "cy"]).select("cx", "cy", F.col("q")[0].alias("_mx"))
    halved = put.join(F.broadcast(across), ["cx", "cy"]).withColumn("_right", (F.col("x") > F.col("_mx")).cast("int"))
    up = quantiles(halved, "y", [0.5], ["cx", "cy", "_right"]).select("cx", "cy", "_right", F.col("q")[0].alias("_my"))
    quarter = halved.join(F.broadcast(up), ["cx", "cy", "_right"]).withColumn("_quarter", F.col("_right") * 2 + (F.col("y") > F.col("_my")).cast("int"))
    return quarter.withColumn("cluster", ((F.col("cx") * cells + F.col("cy")) * 4 + F.col("_quarter")).cast("int")).drop("_mx", "_my", "_right", "_quarter")


def tiled(points: DataFrame, depth: int) -> DataFrame:
    """points (x, y) with `tile`: their cell of an even grid of 2^depth by 2^depth, numbered so that the cells of a coarser grid
    are stretches of these numbers (bits of x and y in turn). Points of one place, or of none, share a tile."""
    cells = 1 << depth
    box = points.agg(*[f(c).alias(f"_{t}{c}") for c in "xy" for t, f in (("lo", F.min), ("hi", F.max))])
    place = lambda c: F.least(F.greatest(F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(f"_lo{c}")) * cells, F.col(f"_hi{c}") - F.col(f"_lo{c}")), F.lit(0.0))), F.lit(0)), F.lit(cells - 1)).cast("long")
    bits = F.lit(0).cast("long")
    for k in range(depth):
        for shift, c in enumerate("xy"):
            bits = bits + F.shiftleft(F.shiftright(place(c), k).bitwiseAND(F.lit(1).cast("long")), 2 * k + shift)
    return points.crossJoin(F.broadcast(box)).withColumn("tile", bits).drop(*[f"_{t}{c}" for c in "xy" for t in ("lo", "hi")])


def tile_index(points: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """A row a tile of every level that has points: level (0 is the whole), tile, records of points and of edges from their
    first on, and the box of the points. points: place, tile, x, y, in the order of place; edges: at, tile, in that of at;
    both are dealt by tile, so the records of a tile of any level are one stretch."""
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    up = F.expr(f"shiftright(tile, 2 * ({depth} - level))")
    # finest tiles first, so that the levels are summed from few rows
    fine = points.groupBy("tile").agg(F.min("place").alias("first_point"), F.count(F.lit(1)).alias("points"), *[f(c).alias(f"{t}_{c}") for c in "xy" for t, f in (("min", F.min), ("max", F.max))])
    links = edges.groupBy("tile").agg(F.min("at").alias("first_edge"), F.count(F.lit(1)).alias("edges"))
    both = fine.join(links, "tile", "left").select("*", level).withColumn("tile", up)
    sums = [F.min("first_point").alias("first_point"), F.sum("points").alias("points"), F.min("first_edge").alias("first_edge"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges")]
    return both.groupBy("level", "tile").agg(*sums, *[f(f"{t}_{c}").alias(f"{t}_{c}") for c in "xy" for t, f in (("min", F.min), ("max", F.max))])


def without_drug_features(nodes: DataFrame, features: str = "features") -> DataFrame:
    """Ablation: all components of the drugs' vectors are zero."""
    return nodes.withColumn(features, F.transform(features, lambda x: x * 0))


def rotated_within(edges: DataFrame, nodes: int, seed: int) -> DataFrame:
    """Ablation: drug ends of each split (edges with split_id) moved by that split's shift."""
    shift = 1 + F.pmod(F.lit(seed).cast("long") * 1000003 + F.col("split_id") * 97, F.lit(max(nodes - 1, 1)))
    return edges.withColumn("node_index", F.pmod(F.col("node_index") + shift, F.lit(nodes)))
