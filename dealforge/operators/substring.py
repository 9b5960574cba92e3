"""Substring search by an index of trigrams (F4, F10): a term reads its rarest postings and the rows they name.

An index is three tables, each with a folder for every batch of rows:

- rows: the rows as they came, in buckets by the hash of their key
- postings: (gram, key, bucket of the row) for every run of three characters of a row's
  lower-cased texts, in buckets by the hash of the gram and sorted by gram inside
- counts: (gram, number of rows that hold it); '' counts all rows

A batch is written whole again if it is run again, so a lost or repeated run does no harm.
Every match is verified on the row; postings only spare rows that cannot match. A term
without a run of three plain characters, or whose rarest run is in a large share of the
rows, reads the rows instead, with the same outcome.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealforge.functions.text import contains_any

BUCKETS = 256
#: A bucket of postings is written by as many tasks, so that a frequent gram is not one task's.
SLICES = 16
#: Postings of as many of a term's rarest grams are intersected.
RAREST = 3
#: From one row in so many on, reading the rows is cheaper than the postings.
SCAN_SHARE = 8
#: A run of three characters, starting anywhere.
_GRAM = r"(?s)(?=(...))"
#: A plain piece of a pattern; % and _ stand for other characters, a backslash makes them plain.
_PIECE = re.compile(r"(?:\\.|[^%_\\])+", re.DOTALL)


def grams(text: Column) -> Column:
    """The runs of three characters of a text, repeats included; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_GRAM), F.lit(1)), F.array().cast("array<string>"))


def pattern_pieces(pattern: str) -> list[str]:
    """The plain pieces of a lower-cased LIKE pattern."""
    return [re.sub(r"\\(.)", r"\1", m, flags=re.DOTALL) for m in _PIECE.findall(pattern)]


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, key: str, columns: list[str], path: str, batch: int = 0, buckets: int = BUCKETS, slices: int = SLICES) -> None:
    """Write a batch of rows to the index at path; all batches take the same key, columns and buckets.

    Keys are unique over all batches; one of them may be null. Rows may have columns of
    any names. An empty table makes an empty index; null texts have no grams.
    """
    kept = rows.select(_bucket(F.col(key), buckets).alias("bucket"), F.col(key).alias("key"), F.struct("*").alias("row"))
    kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch}")
    each = kept.select("bucket", "key", F.explode(F.array_distinct(F.concat(*[grams(F.lower(F.col("row")[c].cast("string"))) for c in columns]))).alias("gram"))
    each = each.withColumn("shelf", _bucket(F.col("gram"), buckets))
    placed = each.repartition("shelf", F.pmod(F.hash("key"), F.lit(slices))).sortWithinPartitions("shelf", "gram", "key")
    placed.write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/postings/batch={batch}")
    written = rows.sparkSession.read.schema(each.schema).parquet(f"{path}/postings/batch={batch}")
    counts = written.groupBy("gram").agg(F.count("*").alias("n")).unionByName(kept.agg(F.count("*").alias("n")).withColumn("gram", F.lit("")))
    shelved = counts.withColumn("shelf", _bucket(F.col("gram"), buckets)).repartition("shelf").sortWithinPartitions("shelf", "gram")
    shelved.write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/counts/batch={batch}")
    schemas = {"rows": kept.schema, "postings": placed.schema, "counts": shelved.schema}
    meta = rows.sparkSession.createDataFrame([(buckets, columns, {name: s.json() for name, s in schemas.items()})], "buckets int, columns array<string>, schemas map<string,string>")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


class SubstringIndex:
    """Reads an index that write_index wrote."""

    def __init__(self, spark: SparkSession, path: str):
        meta = spark.read.parquet(f"{path}/meta").first()
        self.spark, self.path, self.buckets, self.columns = spark, path, meta["buckets"], meta["columns"]
        self.schemas = {name: StructType.fromJson(json.loads(text)) for name, text in meta["schemas"].items()}

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def _grams_of(self, pieces: list[str]) -> dict[str, int]:
        """The distinct grams of some pieces with their buckets: at most as many as a term has characters."""
        if not pieces:
            return {}
        parts = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(p) for p in pieces]), grams)))
        one = self.spark.sql("select 1").select(F.explode(parts).alias("gram"))
        return {r["gram"]: r["shelf"] for r in one.select("gram", _bucket(F.col("gram"), self.buckets).alias("shelf")).collect()}

    def holding(self, pieces: list[str]) -> DataFrame:
        """The rows that may hold all pieces (lower-cased) in their texts: none that does is missing."""
        rows = self._table("rows")
        shelf_of = self._grams_of(pieces)
        if not shelf_of:
            return rows.select("row.*")
        empty = self.spark.sql("select xxhash64('')").first()[0] % self.buckets
        counts = self._table("counts").filter(F.col("shelf").isin([*set(shelf_of.values()), empty]) & F.col("gram").isin([*shelf_of, ""]))
        n = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        total = n.pop("", 0)
        if len(n) < len(shelf_of):  # a gram that no row holds
            return rows.filter(F.lit(False)).select("row.*")
        rarest = sorted(n, key=lambda g: (n[g], g))[:RAREST]
        if n[rarest[0]] * SCAN_SHARE > total:
            return rows.select("row.*")
        postings = self._table("postings").filter(F.col("shelf").isin([shelf_of[g] for g in rarest]) & F.col("gram").isin(rarest))
        found = postings.groupBy("key", "bucket").agg(F.collect_set("gram").alias("held")).filter(F.size("held") == len(rarest)).select(F.col("key").alias("__key"), "bucket")
        buckets = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # at most as many as there are
        return rows.filter(F.col("bucket").isin(buckets)).join(found.select("__key"), F.col("key").eqNullSafe(F.col("__key")), "left_semi").select("row.*")

    def ilike_any(self, pattern: str, *columns: str) -> DataFrame:
        """the rows of which one of the columns (all indexed ones if none is named) is like the pattern, in any case."""
        lowered = self.spark.sql("select 1").select(F.lower(F.lit(pattern))).first()[0]
        hit = F.lit(False)
        for c in columns or self.columns:
            hit = hit | F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False))
        return self.holding(pattern_pieces(lowered)).filter(hit)

    def contains_any(self, term: str, *columns: str) -> DataFrame:
        """the rows of which one of the columns contains the term, in any case."""
        return self.holding([term.lower()]).filter(contains_any(term, *[F.col(c) for c in columns or self.columns]))
