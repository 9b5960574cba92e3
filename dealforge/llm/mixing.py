"""Operator 1: mixing sources to target weights by nested hash thresholds.

Every document hashes to 36 bits. Words are summed by source and by the upper 12
bits; the running sum finds the bucket in which a source's budget ends, only that
bucket is summed again by its next 12 bits, and then by the last 12. What is left
is one threshold a source: a document is taken if its hash lies below it. Nothing
is sorted, and no task gets more than one row a source, bucket and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealforge.llm.common import WORD, n_words, scratch

LEVEL_BITS = 12
LEVELS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def doc_hash(doc_id: Column, text: Column) -> Column:
    """36 uniform bits from an id; a row without an id takes them from its text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 9), 16, 10).cast("long")


def ranked_sources(by_source: DataFrame) -> DataFrame:
    """by_source with `rank`, from 0 in code point order, null last.

    Ranges of sources are numbered each by itself and moved by the sizes of the
    ranges before: the only window over all rows has one row a range.
    """
    dealt = scratch(by_source.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("b_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(F.col("part").alias("b_part")).agg(F.count("*").alias("n")).select("b_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return dealt.join(sizes, F.col("part") == F.col("b_part")).select(*by_source.columns, (inside + F.col("before")).alias("rank"))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target, from rows of (source, size).

    Targets share the sum of all sizes by weight. A source whose share lies above
    max_repeats times its size stops there, and what it leaves is shared anew by
    weight among the others, until none is above: one row of sums a turn comes to
    the driver, whatever the number of sources.
    """
    ranked = ranked_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = scratch(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_repeats))).alias("cap")))
    everything = table.agg(F.sum("source_size")).first()[0]
    level, stopped = 0.0, -1
    while True:
        stops = F.col("cap") / F.col("weight") < F.lit(level)
        n, capped, left = table.agg(F.count_if(stops), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (everything - (capped or 0.0)) / left
    target = F.when(F.col("cap") / F.col("weight") < F.lit(level), F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def hash_thresholds(sized: DataFrame, budgets: DataFrame, levels: int = LEVELS, bits: int = LEVEL_BITS) -> DataFrame:
    """source, threshold: documents with a hash below it hold about `budget` words.

    sized: source, size, hash; budgets: source, budget. Each level splits the
    boundary bucket of the level before; the last boundary bucket is in or out,
    whichever ends nearer to the budget.
    """
    found = scratch(budgets.select(F.col("source").alias("b_source"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("exact")))
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        inside = F.shiftright("hash", shift + bits) == F.col("prefix")
        histogram = (
            sized.join(found, F.col("source").eqNullSafe(F.col("b_source")) & inside)
            .groupBy("b_source", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("below").alias("below"))
        )
        upward = Window.partitionBy("b_source").orderBy("bucket")
        bounds = (
            histogram.withColumn("upto", F.col("below") + F.sum("words").over(upward))
            .filter(F.col("upto") > F.col("budget"))
            .groupBy("b_source", "budget")
            .agg(F.min(F.struct("bucket", "upto", "words")).alias("edge"))
        )
        below = F.col("edge.upto") - F.col("edge.words")
        nearer = (F.col("edge.upto") - F.col("budget")) < (F.col("budget") - below)
        found = scratch(bounds.select("b_source", "budget", F.col("edge.bucket").alias("prefix"), below.alias("below"), nearer.alias("exact")))
    return found.select("b_source", (F.col("prefix") + F.col("exact").cast("long")).alias("threshold"))


def mixing_plan(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """p_source, source_size, target, rounds, threshold: one row a source of (source, size, hash).

    Each document is taken `rounds` times, and once more if its hash lies below the threshold.
    """
    targets = scratch(source_targets(sized, weights, max_repeats))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    thresholds = hash_thresholds(sized, plan.select("source", "budget"))
    plan = plan.join(thresholds, F.col("source").eqNullSafe(F.col("b_source")), "left").withColumnRenamed("source", "p_source")
    return scratch(plan.select("p_source", "source_size", "target", "rounds", F.coalesce("threshold", F.lit(0)).alias("threshold")))


def copies_of(has_words: Column, hash_: Column, max_repeats: int) -> Column:
    """How often the mix takes a document, beside the plan of its source."""
    return F.when(has_words, F.least(F.lit(max_repeats).cast("long"), F.col("rounds") + (hash_ < F.col("threshold")).cast("long"))).otherwise(F.lit(0).cast("long"))


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), doc_hash(F.col(id_col), F.col(text_col)).alias("hash"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per row of docs.

    size counts words; copies is how often the mix takes the document (0 to
    max_repeats); taken = copies * size. A source whose target is above its size
    takes whole rounds of all its documents first. A null source is a source of
    its own, ordered last; a null or blank text has size 0 and is not taken; a null
    id is taken by its text's hash; an empty table gives an empty result; repeated
    rows are taken alike, and so are rows of one id in one source; a very long text
    counts whole; other columns of docs are not read.
    """
    sized = scratch(sizes_of(docs, id_col, text_col, source_col))
    plan = mixing_plan(sized, weights, max_repeats)
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("copies", copies_of(F.col("size") > 0, F.col("hash"), max_repeats))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of docs that the mix takes, repeated as often as it takes them.

    Each row finds its copies by its own source, hash and text: only the plan, one
    row a source, is joined. Rows and columns are those of docs; see mix_sources for
    nulls, repeats and empty tables. Columns of docs may have any names.
    """
    plan = mixing_plan(scratch(sizes_of(docs, id_col, text_col, source_col)), weights, max_repeats)
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col(source_col).alias("source"))
    text = F.col("own")[text_col]
    copies = copies_of(F.coalesce(text.rlike(WORD), F.lit(False)), doc_hash(F.col("own")[id_col], text), max_repeats)
    joined = own.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("copies", copies).filter("copies > 0")
    return joined.select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("own.*")


def op1_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).drop("copies")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))), 1, 9))::BIGINT AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM src),
weighted AS (SELECT *, ([5, 2, 1])[((rk - 1) % 3 + 1)::INT] AS w, source_size * 3.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, cap / w AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighted),
targets AS (SELECT source, source_size, CASE WHEN ratio < lvl THEN cap ELSE w * max(lvl) OVER () END AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS rounds FROM targets),
byhash AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM byhash),
edges AS (
  SELECT p.source, min(struct_pack(h := r.h, upto := r.upto, words := r.words)) AS e, any_value(p.target - p.rounds * p.source_size) AS budget
  FROM running r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source WHERE r.upto > p.target - p.rounds * p.source_size GROUP BY p.source),
thresholds AS (SELECT source, e.h + CASE WHEN e.upto - budget < budget - (e.upto - e.words) THEN 1 ELSE 0 END AS threshold FROM edges)
SELECT s.doc_id, s.size, p.source_size, p.target, (least(3, p.rounds + CASE WHEN s.h < coalesce(t.threshold, 0) THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN thresholds t ON s.source IS NOT DISTINCT FROM t.source
"""
