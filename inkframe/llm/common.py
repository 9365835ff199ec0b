"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a local master, and an error on others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='inkframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder to cut lineage; those of past rounds can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/inkframe-{uuid.uuid4().hex}"
        self.made: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows of df, written once and read back: later plans start here, and lost executors don't lose it."""
        path = f"{self.root}/{len(self.made) + 1}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._inkframe_path = path
        self.made.append(out)
        return out

    def drop_since(self, mark: int, *kept: DataFrame) -> None:
        """Deletes the tables made after the first mark ones, but for those kept."""
        for df in self.made[mark:]:
            if not any(df is k for k in kept):
                self.drop(df)

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that no later plan reads."""
        path = getattr(df, "_inkframe_path", None)
        if path:
            df._inkframe_path = None
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread_join(rows: DataFrame, counted: DataFrame, on: list[str], hot: int = 10_000, parts: int = 64) -> DataFrame:
    """rows joined with counted, a table with one row a key and how many times rows have it (column times, not put out).

    Rows of keys with over hot rows, or over a 10,000th of all, are dealt over parts tasks. So at most 10,000 such keys
    are broadcast.
    """
    total = counted.agg(F.sum("times")).first()[0] or 0
    least = max(hot, total // 10_000)
    many = F.col("times") > least
    salts = F.when(many, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    split = counted.withColumn("_salt", F.explode(salts)).drop("times")
    hot_keys = counted.where(many).select(*on, F.lit(True).alias("_hot"))
    dealt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(parts)).cast("int")
    salted = rows.join(F.broadcast(hot_keys), on, "left").withColumn("_salt", F.when(F.col("_hot"), dealt).otherwise(0))
    return salted.join(split, [*on, "_salt"]).drop("_salt", "_hot")


def hot_keys(rows: DataFrame, on: list[str], scratch: Scratch, hot: int = 10_000) -> DataFrame:
    """The keys of over hot rows, and over a 10,000th of all; so at most 10,000."""
    least = max(hot, rows.count() // 10_000)
    return scratch.cut(rows.groupBy(*on).count().where(F.col("count") > least).select(*on))


def dealt_join(rows: DataFrame, keyed: DataFrame, on: list[str], hot: DataFrame, parts: int = 64) -> DataFrame:
    """rows joined with keyed, a table with one row a key; rows of the keys in hot (see hot_keys) are dealt over parts tasks."""
    marked = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    split = keyed.join(marked, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    own = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(parts)).cast("int")
    salted = rows.join(marked, on, "left").withColumn("_salt", F.when(F.col("_hot"), own).otherwise(0)).drop("_hot")
    return salted.join(split, [*on, "_salt"]).drop("_salt")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add, so that clashing names are replaced."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def map_text(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[..., list[list]]], chunk_bytes: int = 2_000_000, also: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns computed from a text column (null as empty), Arrow batch by Arrow batch; no shuffle.

    make() runs in each task and returns a function from some texts to the new columns' values; it gets at most
    chunk_bytes of text at once (or one longer text), so memory doesn't grow with the batch. Lists of the columns in also
    follow the texts.
    """
    names = [f.name for f in fields]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names} or c == text_col])
    drop_text = text_col in names
    schema = T.StructType([f for f in kept.schema.fields if not (drop_text and f.name == text_col)] + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            column = batch.column(at)
            for lo, hi in chunks(column, chunk_bytes):
                part = batch.slice(lo, hi - lo)
                texts = [x or "" for x in column.slice(lo, hi - lo).to_pylist()]
                made = [pa.array(v, type=t) for v, t in zip(work(texts, *[part.column(part.schema.get_field_index(c)).to_pylist() for c in also]), arrow, strict=True)]
                old = [(part.schema.field(i), part.column(i)) for i in range(part.num_columns) if not (drop_text and i == at)]
                yield pa.RecordBatch.from_arrays([c for _, c in old] + made, names=[f.name for f, _ in old] + names)

    return kept.mapInArrow(run, schema)


def chunks(column: pa.Array, chunk_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about chunk_bytes each."""
    import pyarrow.compute as pc

    lo, size = 0, 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        size += n or 0
        if size >= chunk_bytes:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(column):
        yield lo, len(column)
