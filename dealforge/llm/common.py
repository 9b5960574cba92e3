"""What the operators share: reading tables, the shared scratch folder, word rules."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII blanks that end a word.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a session on one machine makes a temporary folder
    and sets it, so that later calls find the same one; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="dealforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The tables written in each open scratch_space, innermost last.
_spaces: list[list[str]] = []


def scratch(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks after this table only. The
    table stays until the enclosing scratch_space ends, or for whoever reads the
    result if there is none.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    if _spaces:
        _spaces[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def set_inside(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: the table takes their place."""
    return set_inside(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession):
    """What is written inside passes to and from Python in batches of some 4 MB."""
    return set_inside(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by whatever file system its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_space(spark: SparkSession):
    """Tables that scratch writes inside are deleted at the end: what is to stay is written by then."""
    _spaces.append([])
    try:
        yield
    finally:
        for path in _spaces.pop():
            delete(spark, path)


def kept_table(build, spark: SparkSession) -> DataFrame:
    """The table that build() describes, written in the shared folder; build's own tables are deleted."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    with scratch_space(spark):
        df = build()
        df.write.parquet(path)
    if _spaces:
        _spaces[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", -1), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def arrow_schema(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_columns(df: DataFrame, work, schema: str) -> DataFrame:
    """Apply work to Arrow batches of df.

    work takes a dict of lists (one a column) and returns a dict of lists in schema,
    of any length. Batches are bounded by Spark, so memory is too.
    """
    import pyarrow as pa

    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = work({name: batch.column(name).to_pylist() for name in batch.schema.names})
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


#: Letters A to Z lower-cased; every ASCII character but letters and digits is a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def ascii_words(text: bytes | None, most: int = 1 << 20):
    """Lists of the words of a UTF-8 text in order, each from some `most` bytes of it.

    Words are runs of ASCII letters, lower-cased, digits and all other characters
    outside ASCII.
    """
    plain, start = (text or b"").translate(_PLAIN), 0
    while start < len(plain):
        end = plain.find(b" ", start + most)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def binary_text(text_col: str = "text") -> Column:
    """A text as UTF-8 bytes, null for null: tasks read it without decoding."""
    return F.col(text_col).cast("binary").alias("text")


def numbered_by(df: DataFrame, *order: Column) -> DataFrame:
    """df with `place`, from 1 in the given order, as a table in the shared folder and a sum a range.

    Ranges are numbered each by itself and moved by the sizes of the ranges before:
    the only window over all rows has one row a range.
    """
    dealt = scratch(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__b_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(F.col("__part").alias("__b_part")).agg(F.count("*").alias("n")).select("__b_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(sizes), F.col("__part") == F.col("__b_part")).select(*df.columns, (inside + F.col("__before")).alias("place"))  # sizes: one row a partition
