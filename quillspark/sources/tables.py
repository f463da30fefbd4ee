"""Readers and writers of analysis tables and result logs, through Spark's own sources on any of its file systems."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".parquet": "parquet", ".csv": "csv", ".jsonl": "json", ".json": "json", ".orc": "orc"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark finds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def table_path(spark: SparkSession, name: str, folders: Sequence[str], variable: str | None = None) -> str:
    """A table's path: the environment variable's if set, else the first of Parquet before CSV in each folder."""
    if variable and os.environ.get(variable):
        return os.environ[variable]
    for folder in folders:
        for suffix in (".parquet", ".csv"):
            if exists(spark, path := f"{folder.rstrip('/')}/{name}{suffix}"):
                return path
    raise FileNotFoundError(f"no table {name} in {list(folders)}")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Read by suffix. In CSV only the empty field is null: words such as None or NA are values. NaN becomes null."""
    kind = FORMATS[os.path.splitext(path.rstrip("/"))[1].lower()]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        reader = reader.options(header=True, nullValue="", nanValue="NaN", maxColumns=100_000, inferSchema=schema is None)
    return nan_to_null(reader.format(kind).load(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates skip nulls but not NaN, so NaN goes at the boundary."""
    return df.withColumns({f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> int:
    """Write zstd Parquet (the committer makes it appear whole) and count what was written from its footers."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def convert(spark: SparkSession, source: str, target: str, schema: str | None = None) -> int:
    """CSV, JSON lines or any analysis table to uniform Parquet."""
    return write_parquet(read_table(spark, source, schema), target)


def write_once(df: DataFrame, path: str, valid) -> DataFrame:
    """Reuse a complete earlier output that ``valid`` accepts, else write it."""
    spark = df.sparkSession
    if exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        old = spark.read.parquet(path)
        if old.schema.simpleString() == df.schema.simpleString() and valid(old):
            return old
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a CSV folder; each part has its header, so none is lost or doubled."""
    df.write.mode("append").options(header=True, nullValue="").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append records to a JSON-lines log."""
    df.write.mode("append").json(path)


def write_manifest(df: DataFrame, path: str, key: str) -> None:
    """A small table as one indented JSON object: a field for each row, by its key, and all names sorted.

    A manifest has a row for each file or run; keys are unique and not null.
    """
    entry = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns) if c != key])
    fields = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), entry.alias("v"))))
    whole = df.agg(F.to_json(F.map_from_entries(fields), {"pretty": "true"}).alias("value"))
    whole.coalesce(1).write.mode("error").text(path)


def read_manifest(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows of a manifest: its keys and the named fields."""
    told = F.from_json("value", f"map<string, struct<{schema}>>", {"mode": "FAILFAST"})
    return spark.read.text(path, wholetext=True).select(F.explode(told).alias(key, "_v")).select(key, "_v.*")


def log_probability(record: Column, token: Column) -> Column:
    """A log-probability from JSON of several shapes: an object with ``logprob``, such objects by token, or the number."""
    by_token = F.from_json(record, "map<string,string>")
    direct = F.get_json_object(record, "$.logprob")
    inner = F.try_element_at(by_token, token)
    found = F.coalesce(direct, F.get_json_object(inner, "$.logprob"), inner, record)
    return found.try_cast("double")


def input_items(rows: DataFrame, line: str, prompt: str = "prompt", candidates: str = "candidates") -> DataFrame:
    """Lines that are plain prompts, or JSON objects with a prompt and candidates, as (prompt, candidates); blank ones go."""
    kept = rows.where(F.length(F.trim(line)) > 0)
    item = F.from_json(line, f"{prompt} string, {candidates} array<string>")
    is_object = F.startswith(F.ltrim(line), F.lit("{")) & F.get_json_object(line, f"$.{prompt}").isNotNull()
    others = [c for c in rows.columns if c != line]
    return kept.select(*others, F.when(is_object, item[prompt]).otherwise(F.col(line)).alias(prompt), F.when(is_object, item[candidates]).alias(candidates))


def read_log(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool) -> DataFrame:
    """A JSON-lines log under a schema: a bad line fails (strict) or is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # Lines are parsed as a column: the reader's own corrupt-record column can't be counted alone.
    parsed = spark.read.text(path).select(F.from_json("value", T.StructType([*fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def with_origin(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Columns from the file name by a pattern's groups, for a folder with a file for each model."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.withColumns({n: F.regexp_extract(name, pattern, k) for k, n in enumerate(names, 1)})


def files_of(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A manifest: file name, size and SHA-256 of each file of a folder."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_corpus(spark: SparkSession, path: str, targets: str = "target_groups") -> DataFrame:
    """A labelled corpus: (text, label, target, item_index): the first target, and the place within it; bad rows fail."""
    schema = f"id long, text string, label boolean, {targets} array<string>"
    rows = read_log(spark, path, schema, strict=True)
    bad = F.col("text").isNull() | F.col("label").isNull() | (F.size(targets) < 1)
    checked = rows.withColumn("target", F.when(bad, F.raise_error(F.lit("a corpus row lacks text, label or target"))).otherwise(F.get(targets, F.lit(0))))
    from pyspark.sql.window import Window

    return checked.withColumn("item_index", F.row_number().over(Window.partitionBy("target").orderBy("id")).cast("short"))


def numeric_projection(df: DataFrame, columns: Sequence[str], error: str = "error") -> DataFrame:
    """An allow-list of columns and ``has_error``; a missing one fails."""
    if missing := sorted({*columns, error} - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns, F.col(error).isNotNull().alias("has_error"))


def vectors_from_npy(spark: SparkSession, ids: Sequence[int], matrix, id_col: str = "id") -> DataFrame:
    """A driver-side numpy matrix (a weight file, a shard of embeddings) as rows of arrays."""
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, matrix, strict=True)], f"{id_col} long, vector array<double>")


def dropped(path: Column) -> Column:
    """Whether a path is one that packages leave out: caches, compiled files, hidden folders."""
    return path.rlike(r"(^|/)(__pycache__|\.[^/]+)(/|$)") | path.rlike(r"\.(pyc|tmp|partial)$")
