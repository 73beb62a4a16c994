"""Free-text drug names to ingredients: aliases, components, the exact cascade, fuzzy matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .fuzzy import WEIGHTED, Measure, candidates


def aliases(canonical: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(alias, dc_id) of normalised names that mean one ingredient; (id, name) tables. A canonical name wins over a synonym;
    a name of several ids is left out."""
    rows = canonical.select(C.drug_name(F.col("name")).alias("alias"), F.col("id").cast("bigint").alias("dc_id"), F.lit(0).alias("rank"))
    rows = rows.unionByName(synonyms.select(C.drug_name(F.col("name")).alias("alias"), F.col("id").cast("bigint").alias("dc_id"), F.lit(1).alias("rank"))).where("alias <> ''")
    one = rows.groupBy("alias", "rank").agg(F.countDistinct("dc_id").alias("n"), F.min("dc_id").alias("dc_id"))
    first = one.groupBy("alias").agg(F.min_by(F.struct("n", "dc_id"), "rank").alias("best"))
    return first.where("best.n = 1").select("alias", "best.dc_id")


def resolve(names: DataFrame, name: str, known: DataFrame, whole: bool = True) -> DataFrame:
    """(name, ids): the ids of the whole normalised name where that is asked for, else those of all its components (split at /
    and +, empty ones left out), each of which has to mean one id; sorted, null if any fails. known: (alias, dc_id)."""
    sets = known.groupBy("alias").agg(F.array_sort(F.collect_set("dc_id")).alias("ids"))
    one = names.select(name).where(F.col(name).isNotNull()).distinct()
    parts = F.filter(F.transform(F.split(F.upper(F.col(name)), r"\s*(?:/|\+)\s*"), C.drug_name), lambda x: x != "")
    each = one.select(name, F.explode(parts).alias("_part")).join(sets.withColumnsRenamed({"alias": "_part", "ids": "_p"}), "_part", "left")
    both = each.groupBy(name).agg(F.bool_and(F.col("_p").isNotNull() & (F.size("_p") == 1)).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_p")))).alias("_c"))
    out = one.join(both, name, "left").withColumn("ids", F.when(F.col("_all"), F.col("_c")))
    if whole:
        out = out.withColumn("_whole", C.drug_name(F.col(name))).join(sets.withColumnsRenamed({"alias": "_whole", "ids": "_w"}), "_whole", "left").withColumn("ids", F.coalesce("_w", "ids"))
    return out.select(name, "ids")


def exact_cascade(rows: DataFrame, known: DataFrame, rxnorm: DataFrame | None = None) -> DataFrame:
    """(faers_raw, ids, conflict) of (faers_raw, prod_ai) rows: own aliases of prod_ai, then of the name, then RxNorm's of
    prod_ai, then of the name. Where prod_ai lead to several results before anything else decides, it is a conflict and the
    name stays unmapped. RxNorm's whole names may mean several ids."""
    out = raw = rows.select("faers_raw", "prod_ai").distinct()
    tables = [(known, False), *([(rxnorm, True)] if rxnorm is not None else [])]
    for k, (t, whole) in enumerate(tables):
        for by, tag in (("prod_ai", "ai"), ("faers_raw", "name")):
            out = out.join(resolve(raw, by, t, whole).withColumnRenamed("ids", f"_{tag}{k}"), by, "left")
    per = out.groupBy("faers_raw").agg(*[x for k in range(len(tables)) for x in (F.collect_set(f"_ai{k}").alias(f"_ai{k}"), F.max(f"_name{k}").alias(f"_name{k}"))])
    ids, conflict = F.lit(None).cast("array<bigint>"), F.lit(0)
    for k in reversed(range(len(tables))):
        n = F.size(f"_ai{k}")
        ids = F.when(n > 1, F.lit(None)).when(n == 1, F.col(f"_ai{k}")[0]).otherwise(F.coalesce(f"_name{k}", ids))
        conflict = F.when(n > 1, 1).when((n == 1) | F.col(f"_name{k}").isNotNull(), 0).otherwise(conflict)
    return per.select("faers_raw", ids.alias("ids"), conflict.alias("conflict"))


def fuzzy(names: DataFrame, known: DataFrame, cutoff: float = 97, margin: float = 3, measure: Measure = WEIGHTED, rivals: float | None = None) -> DataFrame:
    """(name, alias, score) of names whose best alias reaches the cutoff and leads the next one by the margin. Aliases of
    another first letter don't count, nor do those that score below `rivals` (the cutoff, if not given): they are no rivals.
    Pairs come from the index of `fuzzy.candidates`, so none that counts is lost."""
    least = cutoff if rivals is None else rivals
    scored = candidates(names, known, least / 100, measure).withColumn("score", measure.score(F.col("name"), F.col("alias"))).where(F.col("score") >= least)
    # the two best of a name: the engine keeps no more of each in a task
    two = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("alias"))
    best = scored.withColumn("_r", F.row_number().over(two)).where("_r <= 2").groupBy("name").agg(F.max(F.when(F.col("_r") == 1, F.struct("alias", "score"))).alias("best"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second"))
    return best.where((F.col("best.score") >= cutoff) & (F.col("best.score") - F.coalesce("second", F.lit(0.0)) >= margin)).select("name", "best.alias", "best.score")


def searchable(known: DataFrame, rxnorm: DataFrame | None = None) -> DataFrame:
    """(alias, dc_id) of the aliases of all sources that mean one ingredient."""
    every = known if rxnorm is None else known.unionByName(rxnorm)
    return every.groupBy("alias").agg(F.countDistinct("dc_id").alias("n"), F.min("dc_id").alias("dc_id")).where("n = 1").select("alias", "dc_id")


def fuzzy_cascade(rows: DataFrame, known: DataFrame, cutoff: float = 97, margin: float = 3) -> DataFrame:
    """(faers_raw, ids, conflict) as exact_cascade gives it, with names and components matched to their nearest alias."""
    values = rows.select(F.explode(F.array("prod_ai", "faers_raw")).alias("v")).where(F.col("v").isNotNull()).distinct()
    parts = F.concat(F.array(C.drug_name(F.col("v"))), F.transform(F.split(F.upper("v"), r"\s*(?:/|\+)\s*"), C.drug_name))
    asked = values.select(F.explode(parts).alias("name")).where("name <> ''").distinct()
    near = fuzzy(asked, known, cutoff, margin).join(known, "alias").select(F.col("name").alias("alias"), "dc_id")
    return exact_cascade(rows, near)


def rxnorm_local(identifiers: DataFrame, labels: DataFrame) -> DataFrame:
    """Names of the label mapping (rxcui, rxstring) for the ingredients' identifiers (rxcui, struct_id). Both sides are distinct
    before they meet, so the join makes each row of the result once."""
    names = labels.where(C.filled(F.col("rxcui")) & C.filled(F.col("rxstring"))).select("rxcui", F.col("rxstring").alias("rxnorm_name")).distinct()
    ids = identifiers.select("rxcui", "struct_id").distinct()
    return ids.join(names, "rxcui").select("rxnorm_name", "struct_id", "rxcui", F.lit("drugcentral_identifier").alias("source"), F.lit(None).cast("string").alias("query_name"))


def rxnorm_answers(responses: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the names whose best-ranked candidates all lead to one set of ingredients. responses: query_name, candidates
    (name, rxcui, rank); a name has few candidates."""
    rows = responses.select("query_name", F.posexplode("candidates").alias("place", "c")).select("query_name", "place", "c.*")
    rank = F.coalesce("rank", F.lit(0))
    best = rows.groupBy("query_name").agg(F.min(rank).alias("_best"))
    rows = rows.join(best, "query_name").where(rank == F.col("_best"))
    found = rows.join(resolve(rows, "name", known, whole=False), "name").where("ids is not null")
    one = found.groupBy("query_name").agg(F.size(F.collect_set("ids")).alias("n"), F.min_by(F.struct("name", "rxcui", "ids"), "place").alias("first")).where("n = 1")
    return one.select(F.col("first.name").alias("rxnorm_name"), F.explode("first.ids").alias("struct_id"), F.col("first.rxcui").alias("rxcui"), F.lit("rxnorm_api").alias("source"), "query_name")


def rxnorm_aliases(lookup: DataFrame) -> DataFrame:
    """(alias, dc_id): both names of a lookup row stand for its ingredient."""
    names = F.explode(F.array("rxnorm_name", "query_name"))
    return lookup.where("struct_id is not null").select(names.alias("name"), F.col("struct_id").cast("bigint").alias("dc_id")).select(C.drug_name(F.col("name")).alias("alias"), "dc_id").where("alias <> ''").distinct()


#: Letters of the grams that aliases are found by.
GRAMS = (1, 2, 3)


def _pieces(text: Column, q: int) -> Column:
    """Stretches of q letters, each with how often it came before."""
    plain = F.array_sort(F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: text.substr(i, F.lit(q)))).otherwise(F.array().cast("array<string>")))
    return F.transform(F.array(plain), lambda p: F.transform(p, lambda g, i: F.concat(g, F.lit("#"), (i + 1 - F.array_position(p, g)).cast("string"))))[0]


def write_postings(known: DataFrame, path: str) -> None:
    """Where each gram stands: (q, gram, alias), in the order of q and gram, so that a lookup reads the few row groups that may
    have its grams."""
    grams = F.explode(F.concat(*[_tagged(q) for q in GRAMS])).alias("g")
    rows = known.select("alias").distinct().where("alias is not null").select("alias", grams).select("g.q", "g.gram", "alias")
    rows.repartitionByRange("q", "gram").sortWithinPartitions("q", "gram", "alias").write.mode("overwrite").parquet(path)


def _tagged(q: int) -> Column:
    return F.transform(_pieces(F.col("alias"), q), lambda g: F.struct(F.lit(q).alias("q"), g.alias("gram")))


def suggestions_from(query: str, postings: DataFrame, k: int = 10, cutoff: float = 70.0) -> DataFrame:
    """`suggestions` of stored postings. A stretch that reaches the cutoff is at most d edits from the query, and each edit
    breaks q of its grams of q letters at most, so an alias with fewer of them in common isn't looked at; the longest grams
    that still tell are used. Where none does (very low cutoffs), every alias is scored."""
    text = query.upper().strip()
    n = len(text)
    edits = int((1 - cutoff / 100) * n + 1e-9)
    q, needed = max(((q, n - q + 1 - q * edits) for q in GRAMS if n - q + 1 - q * edits > 0), default=(1, 0))
    if needed <= 0:
        return suggestions(query, postings.where("q = 1"), k, cutoff)
    counts: dict[str, int] = {}
    asked = []
    for i in range(n - q + 1):
        g = text[i : i + q]
        asked.append(f"{g}#{counts.get(g, 0)}")
        counts[g] = counts.get(g, 0) + 1
    near = postings.where((F.col("q") == q) & F.col("gram").isin(asked)).groupBy("alias").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= needed)
    return suggestions(query, near, k, cutoff)


def suggestions(query: str, known: DataFrame, k: int = 10, cutoff: float = 70.0) -> DataFrame:
    """Autocomplete: the k aliases with a stretch as long as the query that is nearest to it, if that reaches the cutoff;
    the shortest of equals first. Stretches are compared by edit distance, JVM-side."""
    text = query.upper().strip()
    n = len(text)
    near = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("alias") - n + 1)), F.lit(1_000_000), lambda out, i: F.least(out, F.levenshtein(F.col("alias").substr(i, F.lit(n)), F.lit(text))))
    scored = known.select("alias").distinct().withColumn("score", 100.0 * (1 - near / max(n, 1)))
    return scored.where(F.col("score") >= cutoff).orderBy(F.desc("score"), F.length("alias"), "alias").limit(k)


def boxed_warnings(sections: DataFrame, labels: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Distinct ids of ingredients with a boxed warning in any label: section by title or LOINC code 34066-1."""
    boxed = sections.where(F.upper("title").like("%BOXED WARNING%") | (F.col("code") == "34066-1")).select("label_id").distinct()
    return labels.join(boxed, "label_id").join(ingredients, "ndc_product_code").where("struct_id is not null").select(F.col("struct_id").cast("bigint").alias("dc_id")).distinct()


def atc_by_structure(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("struct_id").cast("bigint").alias("dc_id")).agg(F.array_join(F.array_sort(F.collect_set(F.upper(F.trim("atc_code")))), "|").alias("atc_code"))


#: Pairs of name and id up to which they go to every task (8 bytes a pair in arrays); more are joined by a shuffle.
BROADCAST_PAIRS = 4_000_000
#: Cells of reports and ids that a task marks at once.
CELLS = 4_000_000


def ids_of(named: DataFrame, key: str, pairs: DataFrame, id: str, otherwise: Column | None = None) -> DataFrame:
    """(key, ids): the distinct ids that a key's names stand for. named: (key, faers_raw), pairs: (faers_raw, id); a name may
    have many ids. Names meet by key first and their ids come to them as arrays, so no row of a key and an id is shuffled.
    A name without pairs, null too, has the ids `otherwise`; unless given, keys with such names only are left out."""
    known = pairs.groupBy("faers_raw").agg(F.collect_set(id).alias("_ids"))
    known = F.broadcast(known) if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else known
    # a struct, as sets leave out nulls
    names = named.groupBy(key).agg(F.collect_set(F.struct("faers_raw")).alias("_n")).select(key, F.explode("_n").alias("_n")).select(key, "_n.faers_raw")
    found = names.join(known, "faers_raw", "inner" if otherwise is None else "left")
    ids = F.col("_ids") if otherwise is None else F.coalesce("_ids", otherwise)
    return found.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(ids))).alias("ids"))


def counted_ids(named: DataFrame, reports: DataFrame, pairs: DataFrame, id: str, otherwise: list[int] | None = None) -> DataFrame:
    """(id, a, b): how many serious and other reports have a name of the id. named: (report, faers_raw), reports: (report,
    is_serious), pairs and otherwise as in ids_of. Tasks mark a report's ids and hand on a row an id: a report's ids are
    neither listed nor shuffled, so what is shuffled are names, whatever number of ids they have."""
    pairs = pairs.select("faers_raw", F.col(id).cast("long").alias("_id")).where(F.col("faers_raw").isNotNull())
    serious = F.col("is_serious") == 1
    reports = reports.select("report", "is_serious")
    if pairs.limit(BROADCAST_PAIRS + 1).count() > BROADCAST_PAIRS:
        default = None if otherwise is None else F.array(*[F.lit(x) for x in otherwise]).cast("array<bigint>")
        seen = ids_of(named, "report", pairs, "_id", default).join(reports, "report").select(F.explode("ids").alias(id), "is_serious")
        return seen.groupBy(id).agg(F.count_if(serious).alias("a"), F.count_if(~serious).alias("b"))
    marked, values = _marks(named.sparkSession, pairs, otherwise)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(values)), dtype="int64")
        for batch in batches:
            flags = batch["serious"].to_numpy()
            for lo, hit in marked(batch["names"]):
                own = flags[lo : lo + len(hit)]
                for j in (0, 1):
                    total[j] += hit[own == j].sum(0, dtype="int64")
        some = total.sum(0) > 0
        yield pa.RecordBatch.from_arrays([pa.array(values[some], pa.int64()), pa.array(total[1][some]), pa.array(total[0][some])], names=[id, "a", "b"])

    # a report without a known outcome counts nowhere
    own = _listed(named, "report").join(reports.where(serious.isNotNull()), "report")
    rows = own.select("names", serious.cast("int").alias("serious"))
    return rows.mapInArrow(tally, f"{id} long, a long, b long").groupBy(id).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def linked(named: DataFrame, key: str, pairs: DataFrame, id: str, otherwise: list[int] | None = None) -> DataFrame:
    """Distinct (key, id) of the ids that a key's names stand for: the rows of ids_of. Names are shuffled and grouped, ids are
    not: tasks mark those of some keys at once and hand them on."""
    pairs = pairs.select("faers_raw", F.col(id).cast("long").alias("_id")).where(F.col("faers_raw").isNotNull())
    if pairs.limit(BROADCAST_PAIRS + 1).count() > BROADCAST_PAIRS:
        default = None if otherwise is None else F.array(*[F.lit(x) for x in otherwise]).cast("array<bigint>")
        return ids_of(named, key, pairs, "_id", default).select(key, F.explode("ids").alias(id))
    marked, values = _marks(named.sparkSession, pairs, otherwise)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hit in marked(batch["names"]):
                row, at = np.nonzero(hit.view(bool))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(hit)))]).astype("int32")
                yield pa.RecordBatch.from_arrays([batch[key][lo : lo + len(hit)], pa.ListArray.from_arrays(pa.array(ends), pa.array(values[at], pa.int64()))], names=[key, "ids"])

    rows = _listed(named, key)
    return rows.mapInArrow(spread, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<bigint>").select(key, F.explode("ids").alias(id))


def _listed(named: DataFrame, key: str) -> DataFrame:
    """(key, names): the distinct names of each key, null too (in a struct, as sets leave out nulls)."""
    return named.groupBy(key).agg(F.collect_set(F.struct("faers_raw")).alias("_n")).select(key, F.col("_n.faers_raw").alias("names"))


def _marks(spark: SparkSession, pairs: DataFrame, otherwise: list[int] | None):
    """A function for tasks, from lists of names to (first list, matrix of lists and ids: 1 where one of the names has the id),
    some lists at a time, and the ids. pairs: (faers_raw, _id), at most BROADCAST_PAIRS; they go to every task."""
    known = pairs.groupBy("faers_raw").agg(F.collect_set("_id").alias("ids")).toArrow()
    lists = known["ids"].combine_chunks()
    values, places = np.unique(np.concatenate([lists.flatten().to_numpy(), np.array(otherwise or [], dtype="int64")]), return_inverse=True)
    # the last stretch is that of names without pairs
    starts = np.concatenate([lists.offsets.to_numpy() - lists.offsets[0].as_py(), [len(places)]]).astype("int64")
    table = spark.sparkContext.broadcast((known["faers_raw"].combine_chunks(), starts, places.astype("int32")))
    k = len(values)

    def marked(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        names, starts, places = table.value
        if not k:
            return
        sizes = np.diff(starts)
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), len(names)).to_numpy()
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for lo in range(0, len(lists), step := max(1, CELLS // k)):
            cut = ends[lo : lo + step + 1]
            here = at[cut[0] : cut[-1]]
            n = sizes[here]
            ids = places[np.arange(n.sum()) + np.repeat(starts[here] - np.cumsum(n) + n, n)]
            hit = np.zeros((len(cut) - 1) * k, dtype="uint8")
            hit[np.repeat(np.repeat(np.arange(len(cut) - 1) * k, np.diff(cut)), n) + ids] = 1
            yield lo, hit.reshape(-1, k)

    return marked, values


def dictionary_ror(dictionary: DataFrame, report_drug: DataFrame, cohort: DataFrame) -> DataFrame:
    """The dictionary with its ROR over all splits (conditional smoothing). Unmapped names share id 0 and one ROR."""
    from .risk import with_ror, with_totals

    named = report_drug.select(F.col("primaryid").alias("report"), F.trim("drugname").alias("faers_raw"))
    reports = cohort.select(F.col("primaryid").alias("report"), "is_serious", "split")
    rors = with_ror(with_totals(counted_ids(named, reports, dictionary, "dc_id"), reports, ["dc_id"]), "zero").select("dc_id", "ror")
    return dictionary.drop("ror").join(rors, "dc_id", "left")


def unmapped_by_frequency(edges: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """The k most frequent unknown names of training edges (edge rows count), with their rank."""
    seen = edges.where("split = 'train'").where(C.filled(F.col("faers_raw"))).groupBy("faers_raw").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("faers_raw")]
    top = seen.join(dictionary.select("faers_raw").distinct(), "faers_raw", "left_anti").orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def consensus(candidates: DataFrame) -> DataFrame:
    """(query_name, struct_id): names whose best-ranked candidates lead to one id only."""
    best = candidates.groupBy("query_name").agg(F.min("rank").alias("rank"))
    ids = candidates.join(best, ["query_name", "rank"]).groupBy("query_name").agg(F.countDistinct("struct_id").alias("n"), F.min("struct_id").alias("struct_id"))
    return ids.where("n = 1").select("query_name", "struct_id")


def tokens_of(column: Column) -> Column:
    """Names of a typed list: commas and line ends part them."""
    return F.filter(F.transform(F.split(F.regexp_replace(column, "\n", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
