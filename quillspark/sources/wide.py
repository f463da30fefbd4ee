"""Folders of files whose number is known, and CSV rows of thousands of columns as one array a row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A field and the comma behind it; quoted ones hold commas and doubled quotes.
_FIELD = r'("(?:[^"]++|"")*+"|[^,"]*+),'


def expected_files(spark: SparkSession, path: str, glob: str, expected: int) -> list[str]:
    """The folder's files, sorted; an error if there aren't as many as expected."""
    # Of the files' own reader only the path is asked for, so none is opened.
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    found = sorted(r["path"] for r in files.select("path").limit(expected + 1).collect())
    if len(found) != expected:
        raise ValueError(f"{path}: {'more than ' if len(found) > expected else ''}{min(len(found), expected)} files of {glob} where {expected} are expected")
    return found


def lines(rows: DataFrame, header: str, line: Column, file: Column, files: int) -> DataFrame:
    """(value) in as many partitions as files, each the header and its rows' lines: ``file`` tells a row's, from 0.

    The header is sorted to a partition's front before lines are made of the rows, so no task holds lines.
    """
    own = rows.select(F.lit(1).alias("_part"), file.cast("int").alias("_file"), F.struct("*").alias("_row"))
    first = rows.sparkSession.createDataFrame([(0, k) for k in range(files)], "_part int, _file int")
    dealt = first.unionByName(own, allowMissingColumns=True).repartitionById(files, F.col("_file")).sortWithinPartitions("_part")
    return dealt.select("_part", "_row.*").select(F.when(F.col("_part") == 0, header).otherwise(line).alias("value"))


def fields(line: Column) -> Column:
    """A CSV line's fields as an array of strings: unquoted, empty ones null. A field holds no line break."""
    own = F.regexp_extract_all(F.concat(F.regexp_replace(line, "\\r$", ""), F.lit(",")), F.lit(_FIELD), F.lit(1))
    quoted = lambda x: F.replace(F.substr(x, F.lit(2), F.char_length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(own, lambda x: F.when(x.startswith('"'), quoted(x)).otherwise(F.nullif(x, F.lit(""))))


def wide_rows(spark: SparkSession, files: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(cells) a row, and the header's names. All files have the first one's header; rows of another width are an error.

    A row is one array, so the plan doesn't grow with the columns.
    """
    first = spark.read.text(files[0]).first()
    if first is None:
        raise ValueError(f"{files[0]}: a header is expected")
    names = spark.createDataFrame([first], "value string").select(fields(F.col("value"))).first()[0]
    # A generator keeps Spark from parsing a line again wherever its fields are asked for.
    cells = spark.read.text(list(files)).where((F.col("value") != first["value"]) & (F.col("value") != "")).select(F.inline(F.array(F.struct(fields(F.col("value")).alias("cells")))))
    width = F.raise_error(F.format_string("a row of %d fields where the header has %d", F.size("cells"), F.lit(len(names))))
    return cells.select(F.when(F.size("cells") == len(names), F.col("cells")).otherwise(width).alias("cells")), names


def unfolded(rows: DataFrame, names: Sequence[str], keys: dict[str, str], pattern: str, values: dict[str, str]) -> DataFrame:
    """Long rows (keys, item, values). ``pattern``: matches a repeated column's name, with its item and its value's name as groups.

    ``keys`` and ``values`` tell types by name. Items that lack a value's column have null there.
    """
    places: dict[int, dict[str, int]] = {}
    for k, name in enumerate(names):
        if (m := re.fullmatch(pattern, name)) and m[2] in values:
            places.setdefault(int(m[1]), {})[m[2]] = k
    if missing := [c for c in keys if c not in names]:
        raise ValueError(f"no columns {missing}")
    items = sorted(places)
    # One parsed expression: thousands of literals one by one take seconds to make.
    numbers = lambda own: F.expr(f"cast(array({', '.join('null' if k is None else str(k) for k in own)}) as array<int>)")
    at = {v: numbers(places[i].get(v) for i in items) for v in values}
    own = [F.get("cells", F.lit(list(names).index(c))).cast(kind).alias(c) for c, kind in keys.items()]
    ids = numbers(items)
    # An array of small rows first: exploding beside the cells would copy them for each item.
    one = lambda k: F.struct(F.get(ids, k).alias("item"), *[F.get("cells", F.get(at[v], k)).cast(kind).alias(v) for v, kind in values.items()])
    each = F.transform(F.sequence(F.lit(0), F.lit(len(items) - 1)), one) if items else F.array().cast(f"array<struct<item:int,{','.join(f'{v}:{k}' for v, k in values.items())}>>")
    return rows.select(*own, F.inline(each))
