"""Reading tables, shards and logs; idempotent keyed writes; report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.operators.order import carry_forward
from histomesh.session import durable


def read_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, rename: dict[str, str] | None = None, schema=None
) -> DataFrame:
    """Parquet or CSV by suffix. CSV needs ``schema``; only ``columns`` are read; ``rename`` maps names."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("reading CSV needs an explicit schema")
        df = spark.read.csv(path, header=True, schema=schema)
    else:
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if columns is not None:
        df = df.select(*columns)
    return df.withColumnsRenamed(rename) if rename else df


def read_shards(spark: SparkSession, path: str, key: str = "slide_id") -> DataFrame:
    """A folder of per-key parquet shards as one table; filters on ``key`` prune folders."""
    return spark.read.option("basePath", path).parquet(path)


def fold_embedding(df: DataFrame, prefix: str = "emb_", name: str = "embedding") -> DataFrame:
    """Numbered columns ``emb_0, emb_1, ...`` into one ARRAY<FLOAT>, in numeric order."""
    parts = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    rest = [c for c in df.columns if c not in parts]
    return df.select(*rest, F.array(*[F.col(c).cast("float") for c in parts]).alias(name))


def done_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys whose rows are completely written under ``path``; None before the first write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_done")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{path}/_done").select(key).distinct()


def write_cached(df: DataFrame, path: str, key: str = "slide_id", force: bool = False) -> None:
    """Write each key once: keys already done are skipped unless ``force``.

    The small table ``_done`` beside the shards (readers skip its name) gets the keys after their
    rows are there. A crash in between leaves keys that are not marked; the next write replaces
    their folders whole. Until then a reader may see such a key; ``done_keys`` tells which are complete.
    """
    present = None if force else done_keys(df.sparkSession, path, key)
    todo = df if present is None else df.join(present, key, "left_anti")
    keys = durable(todo.select(key).distinct())
    # gather each key's rows, so a key gets few files; adaptive execution splits a key that is too large
    rows = todo.hint("rebalance", key)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    keys.write.mode("append").parquet(f"{path}/_done")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# The four line formats of a training log.
SEED_LINE = r"seed (\d+) \| .* slides"
START_LINE = r"HabitatNet\[(\w+)\]"
EPOCH_LINE = r"epoch\s+(\d+)\s+loss ([\d.]+)\s+acc ([\d.]+)\s+f1 ([\d.]+)"
RESULT_LINE = r"seed (\d+) (\w+)\s+macro_f1 ([\d.]+)\s+min_recall ([\d.]+)(?:\s+COLLAPSED classes: (\[[^\]]*\]))?"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with an order key: file, byte offset of its block, position in the block."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def _group(pattern: str, i: int):
    text = F.regexp_extract("line", pattern, i)
    return F.when(text != "", text)


def parse_epochs(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Epoch rows with the seed and mode announced last before them in the same log."""
    marked = lines.select(
        *keys, *order, "line", _group(SEED_LINE, 1).cast("int").alias("seed"), _group(START_LINE, 1).alias("mode")
    )
    # only announcements and epochs matter for the carry
    relevant = marked.filter(F.col("seed").isNotNull() | F.col("mode").isNotNull() | F.col("line").rlike(EPOCH_LINE))
    carried = carry_forward(relevant, keys, order, ["seed", "mode"])
    number = lambda i, kind: _group(EPOCH_LINE, i).cast(kind)
    return carried.filter(F.col("line").rlike(EPOCH_LINE) & F.col("seed").isNotNull() & F.col("mode").isNotNull()).select(
        *keys, *order, "seed", "mode", number(1, "int").alias("epoch"), number(2, "double").alias("loss"),
        number(3, "double").alias("acc"), number(4, "double").alias("f1"),
    )


def parse_results(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Finished runs with the list and number of collapsed classes."""
    collapsed = F.coalesce(_group(RESULT_LINE, 5), F.lit("[]"))
    inner = F.filter(F.split(F.regexp_replace(collapsed, r"[\[\]]", ""), ","), lambda x: F.trim(x) != "")
    return lines.filter(F.col("line").rlike(RESULT_LINE)).select(
        *keep, _group(RESULT_LINE, 1).cast("int").alias("seed"), _group(RESULT_LINE, 2).alias("mode"),
        _group(RESULT_LINE, 3).cast("double").alias("macro_f1"), _group(RESULT_LINE, 4).cast("double").alias("min_recall"),
        collapsed.alias("collapsed_classes"), F.size(inner).alias("n_collapsed"),
    )


def read_log(spark: SparkSession, path: str, in_parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(epochs, results) of every log file under ``path``; ``in_parts``: the files of a folder, by name, are one log."""
    lines, order = log_lines(spark, path), ["block", "line_no"]
    if in_parts:
        lines, order = lines.withColumn("folder", F.regexp_replace("file", "/[^/]*$", "")), ["file", *order]
    keys = ["folder" if in_parts else "file"]
    return parse_epochs(lines, keys, order), parse_results(lines, keys)


def parse_key_values(column: str):
    """'a=b, c=d' text as a map, trimmed."""
    return F.transform_values(
        F.transform_keys(F.str_to_map(F.col(column), F.lit(","), F.lit("=")), lambda k, v: F.trim(k)), lambda k, v: F.trim(v)
    )
