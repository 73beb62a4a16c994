"""Rows that joins and shuffles make, on inputs where they once grew faster than the input."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlark.operators import fuzzy as FZ
from medlark.operators import graph as GR
from medlark.operators import names as NA
from medlark.operators import ranges as RG
from medlark.plans import queries as Q


def made(df: DataFrame, kind: str, metric: str) -> int:
    """Runs df and sums a metric over its operators of a kind."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()

    def walk(node) -> int:
        name, n = node.nodeName(), 0
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        found = node.metrics().get(metric)
        if kind in name and found.isDefined():
            n += found.get().value()
        kids = node.children()
        return n + sum(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(qe.executedPlan())


def test_rxnorm_rows_meet_once(spark):
    identifiers = spark.range(3000).select((F.col("id") % 3).cast("string").alias("rxcui"), (F.col("id") % 2).alias("struct_id"))
    labels = spark.range(2000).select((F.col("id") % 3).cast("string").alias("rxcui"), F.lit("a").alias("rxstring"))
    out = NA.rxnorm_local(identifiers, labels)
    assert out.count() == 6 and out.distinct().count() == 6
    assert made(out, "Join", "numOutputRows") == 6


def _many_ids(spark, ids: int):
    named = spark.range(400).select((F.col("id") % 100).alias("report"), F.concat(F.lit("n"), (F.col("id") % 21).cast("string")).alias("faers_raw")).unionByName(spark.createDataFrame([(1, None)], "report long, faers_raw string"))
    reports = spark.range(100).select(F.col("id").alias("report"), F.when(F.col("id") % 7 > 0, (F.col("id") % 2).cast("int")).alias("is_serious"))
    pairs = spark.range(20 * ids).select(F.concat(F.lit("n"), (F.col("id") % 20).cast("string")).alias("faers_raw"), F.when(F.col("id") % 20 > 0, F.col("id") % (3 * ids)).alias("dc_id"))
    return named, reports, pairs


def test_counted_ids_equal_listed_ones_on_both_paths(spark, monkeypatch):
    named, reports, pairs = _many_ids(spark, 50)
    for otherwise in (None, [], [-1]):
        default = None if otherwise is None else F.array(*[F.lit(x).cast("long") for x in otherwise]).cast("array<bigint>")
        listed = NA.ids_of(named, "report", pairs, "dc_id", default).select("report", F.explode("ids").alias("dc_id"))
        seen = listed.join(reports, "report")
        listed = sorted(map(tuple, listed.collect()))
        wanted = sorted(map(tuple, seen.groupBy("dc_id").agg(F.count_if(F.col("is_serious") == 1), F.count_if(F.col("is_serious") == 0)).collect()))
        for cells, most in ((NA.CELLS, NA.BROADCAST_PAIRS), (7, NA.BROADCAST_PAIRS), (NA.CELLS, 5)):
            monkeypatch.setattr(NA, "CELLS", cells)
            monkeypatch.setattr(NA, "BROADCAST_PAIRS", most)
            assert sorted(map(tuple, NA.linked(named, "report", pairs, "dc_id", otherwise).collect())) == listed, (otherwise, cells, most)
            found = sorted(map(tuple, NA.counted_ids(named, reports, pairs, "dc_id", otherwise).collect()))
            assert [r for r in found if r[1] + r[2]] == [r for r in wanted if r[1] + r[2]], (otherwise, cells, most)
            monkeypatch.undo()


def test_shuffled_rows_of_rors_do_not_grow_with_the_ids_of_a_name(spark):
    def shuffled(ids: int) -> int:
        named, reports, pairs = _many_ids(spark, ids)
        cohort = reports.withColumnRenamed("report", "primaryid").withColumn("split", F.lit("train"))
        out = NA.dictionary_ror(pairs.distinct().cache(), named.select(F.col("report").alias("primaryid"), F.col("faers_raw").alias("drugname")), cohort)
        return made(out, "Generate", "numOutputRows")

    assert shuffled(1000) == shuffled(10)


def test_edges_are_made_without_collecting_the_ids_of_names(spark):
    named, _, pairs = _many_ids(spark, 100)
    nodes = spark.range(300).select(F.col("id").alias("node_index"), F.col("id").alias("semantic_id"), F.lit("mapped").alias("node_kind"), F.lit("").alias("node_label"))
    out = GR.graph_edges(named.withColumnRenamed("report", "patient_index"), pairs, spark.createDataFrame([], "faers_raw string, rank int"), nodes)
    assert out.count() == out.distinct().count() > 5_000
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_fuzzy_candidates_do_not_go_to_all_tasks_by_the_driver(spark):
    label = F.concat(F.lit("LARGE RING PROMO LOT "), F.col("id").cast("string"))
    names, aliases = spark.range(300).select(F.concat(label, F.lit("X")).alias("name")), spark.range(300).select(label.alias("alias"))
    for r in (0.97, 0.8):
        out = FZ.candidates(names, aliases, r)
        # what may be sent is how often each gram is seen; names ask dozens of times
        assert made(out, "BroadcastExchange", "numOutputRows") <= 200, r
        assert out.count() >= 300


def meetings(df: DataFrame) -> int:
    """Pairs of rows that the joins of df bring together by key and letter, whatever their conditions keep of them."""
    spark, found, plans = df.sparkSession, 0, [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Join":
            sides = [DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, side), spark) for side in (plan.left(), plan.right())]
            by = [c for c in sides[0].columns if c in ("initial", "key")]
            a, b = (side.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for side, n in zip(sides, "ab", strict=True))
            found += a.join(b, by).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    return found


def test_names_of_one_boilerplate_do_not_all_meet(spark):
    aliases = spark.range(1000).selectExpr("concat('LARGE RING PROMO BRAND#12 LOT ', 100000 + id * 7919 % 900001) as alias")
    # without a letter of the boilerplate, with another one, with one more in the number
    edits = [F.regexp_replace("alias", "RING", "RIG"), F.regexp_replace("alias", "RING", "RXNG"), F.regexp_replace("alias", "(.)$", "7$1")]
    names = aliases.select(F.explode(F.array(*edits)).alias("name"))
    out = FZ.candidates(names, aliases, 0.97)
    assert out.count() >= 3000
    # 3,000,000 pairs of one letter and boilerplate
    assert meetings(out) <= 60_000


@pytest.mark.parametrize("make", [Q.edge_dedup, Q.atc_hierarchy_counts, Q.exposure_documentation, Q.indication_features, Q._links], ids=lambda f: f.__name__)
def test_a_task_holds_no_more_rows_than_its_share(spark, monkeypatch, make):
    """Short rows in small shuffle files were coalesced into few tasks, each of which hashed millions."""
    monkeypatch.setattr(RG, "ROWS", 500)
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert make(spark, folder)._jdf.queryExecution().toRdd().getNumPartitions() >= lines / 500
