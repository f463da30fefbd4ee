"""Operator 1, URL filters: a temporal list join.

Lists are histories: dated entries that add a key to a list or remove it. Entries become validity intervals
(from an add up to the next remove), and every capture is judged by the entries that were active when it was
fetched. Keys name a domain with all below it (``d:example.com``), a host with a path of any depth and all below it (``p:example.com/a/b``), or one URL without its fragment (``u:example.com/a?b``).

The as-of join is an equi-join on the key and a span of days, into which intervals are split, with the interval
as a further condition: work follows the matches, and a key that a third of all captures share is a skewed join
side, which adaptive execution splits. Captures are reduced to distinct pairs of URL and day before the join, so
repeats of a hot URL move once. The most specific active entry decides: URL before path before domain, then the
longer key; among equals an allowing list wins, then the list's name that sorts last.

Defined cases: a null URL, or one without scheme and host or with a host of over 253 characters, matches nothing;
a null time matches nothing; on a day with an add and a remove of one key the add holds; removing what isn't
listed does nothing; entries with nulls are ignored; repeated captures each keep their row; other columns are
carried whatever their names, and new ones replace those of the same name; empty tables give no rows, or no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import free

#: Days of a span.
SPAN = 64
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"
NEW = ("host", "verdict", "matched_key", "matched_list", "listed_from", "n_active")


def host_of(url: Column) -> Column:
    """The lower-cased host without a closing dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", "")
    return F.when((F.length(host) > 0) & (F.length(host) <= 253), host)


def keys_of(url: Column, host: Column, deepest: int) -> Column:
    """All keys that may list a URL, where no listed path has more than ``deepest`` segments."""
    labels, path = F.split(host, r"\."), F.regexp_extract(url, _URL, 2)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    depth = F.least(F.size(segments), F.lit(deepest))
    paths = F.transform(F.slice(F.sequence(F.lit(1), F.lit(max(1, deepest))), F.lit(1), depth), lambda k: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/")))
    return F.concat(domains, paths, F.array(F.concat(F.lit("u:"), host, path, F.regexp_extract(url, _URL, 3))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, allow, key, since, until) from entries (list, allow, key, action, day); ``until`` is null while it lasts.

    A day's entries of one key are one row first, so a window holds at most the days of a key's history.
    """
    listed = F.max(F.col("action") == "add").alias("listed")
    days = entries.where("list is not null and key is not null and day is not null and action in ('add', 'remove')").groupBy("list", "key", "day").agg(listed, F.max(F.coalesce("allow", F.lit(False))).alias("allow"))
    w = Window.partitionBy("list", "key").orderBy("day")
    changes = days.withColumn("before", F.lag("listed").over(w)).where("not (listed <=> before)")
    return changes.withColumn("until", F.lead("day").over(w)).where("listed").select("list", "allow", "key", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """``captures`` with :data:`NEW`: verdict ``allow``, ``block`` or ``none``, what decided it, and the active entries' number."""
    rows = captures.select(*[F.col(f"`{c}`") for c in captures.columns if c.lower() not in NEW])
    u, d, best, active = free([*rows.columns, *NEW], "u", "d", "best", "active")
    seen = rows.select(F.col(url_col).cast("string").alias("_u"), F.col(day_col).cast("date").alias("_d")).where("_u is not null and _d is not null").distinct()
    deepest = entries.where("key like 'p:%'").agg(F.max(F.size(F.filter(F.split(F.substr("key", F.lit(3)), "/"), lambda x: x != "")) - 1)).first()[0] or 0
    first_day, last_day = seen.agg(F.min("_d"), F.max("_d")).first()
    probes = seen.withColumn("host", host_of(F.col("_u"))).where("host is not null").select("_u", "_d", F.explode(F.array_distinct(keys_of(F.col("_u"), F.col("host"), deepest))).alias("key"), F.floor(F.unix_date("_d") / SPAN).alias("span"))
    until = F.coalesce(F.date_sub("until", 1), F.lit(last_day).cast("date"))
    begins, ends = F.greatest("since", F.lit(first_day).cast("date")), F.least(until, F.lit(last_day).cast("date"))
    valid = intervals(entries).withColumns({"since_day": begins, "last": ends}).where("since_day <= last")
    valid = valid.withColumn("span", F.explode(F.sequence(F.floor(F.unix_date("since_day") / SPAN), F.floor(F.unix_date("last") / SPAN))))
    met = probes.join(valid, (probes["key"] == valid["key"]) & (probes["span"] == valid["span"]) & (F.col("_d") >= F.col("since")) & (F.col("until").isNull() | (F.col("_d") < F.col("until"))))
    rank = F.struct(F.substr(valid["key"], F.lit(1), F.lit(1)).alias("kind"), F.length(valid["key"]).alias("size"), "allow", F.col("list"), valid["key"].alias("key"), "since")
    # By letter, u comes after p and p after d: the more specific kind is the larger.
    verdicts = met.groupBy(F.col("_u").alias(u), F.col("_d").alias(d)).agg(F.max(rank).alias(best), F.count("*").alias(active))
    top = F.col(best)
    joined = rows.join(verdicts, (F.col(url_col).cast("string") == F.col(u)) & (F.col(day_col).cast("date") == F.col(d)), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        host_of(F.col(url_col).cast("string")).alias("host"),
        F.when(top.isNull(), "none").when(top["allow"], "allow").otherwise("block").alias("verdict"),
        top["key"].alias("matched_key"),
        top["list"].alias("matched_list"),
        top["since"].alias("listed_from"),
        F.coalesce(active, F.lit(0)).cast("long").alias("n_active"),
    )


def _number(x: str) -> str:
    return f"cast(conv(substr(md5({x}), 1, 6), 16, 10) as int)"


#: The query's lists, from the hosts of the table: list, allow, key, action, day after 2024-01-01, which hosts (h: a number from the host's MD5).
_ENTRIES = [
    ("'spam'", "false", "'d:' || host", "'add'", "h % 300", "h % 10 < 3"),
    ("'spam'", "false", "'d:' || host", "'remove'", "h % 300 + 60", "h % 20 < 2"),
    ("'spam'", "false", "'d:' || host", "'add'", "h % 300 + 90", "h % 40 < 2"),
    ("'good'", "true", "'d:' || host", "'add'", "50", "h % 7 = 0"),
    ("'good'", "true", "'d:' || host", "'remove'", "250", "h % 14 = 0"),
    ("'paths'", "false", "'p:' || host || '/en'", "'add'", "h % 200", "h % 9 = 0"),
    ("'adult'", "false", "'d:example.net'", "'add'", "30", "h % 2 = 0"),
    ("'adult'", "false", "'d:example.net'", "'remove'", "120", "h % 2 = 0"),
    ("'adult'", "false", "'d:example.net'", "'add'", "200", "h % 2 = 1"),
]
_FETCHED = "date_add(date '2024-01-01', cast(page_id % 366 as int))"


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """The query: every page, fetched on a day that its id gives, under lists of the table's own hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").withColumn("fetched", F.expr(_FETCHED))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("h", F.expr(_number("host")))
    rows = F.array(*[F.struct(F.expr(name).alias("list"), F.expr(allow).alias("allow"), F.expr(key).alias("key"), F.expr(action).alias("action"), F.expr(f"date_add(date '2024-01-01', cast({day} as int))").alias("day"), F.expr(where).alias("held")) for name, allow, key, action, day, where in _ENTRIES])
    entries = hosts.select(F.inline(rows)).where("held").drop("held").distinct()
    return filter_urls(pages, entries)


ORACLE_SQL = f"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT fetched,
    regexp_replace(lower(regexp_extract(url, '{_URL}', 1)), '\\.$', '') host0,
    regexp_extract(url, '{_URL}', 2) path, regexp_extract(url, '{_URL}', 3) query FROM pages),
p AS (SELECT *, CASE WHEN length(host0) BETWEEN 1 AND 253 THEN host0 END host FROM c),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::INT h FROM p WHERE host IS NOT NULL),
e AS ({" UNION ".join(f"SELECT {name} list, {allow} allow, {key} AS key, {action} AS action, DATE '2024-01-01' + ({day})::INT AS day FROM hosts WHERE {where}" for name, allow, key, action, day, where in _ENTRIES)}),
s AS (SELECT list, allow, key, day, bool_or(action = 'add') listed, lead(day) OVER (PARTITION BY list, key ORDER BY day) until FROM e GROUP BY list, allow, key, day),
k AS (SELECT DISTINCT url, fetched, unnest(list_concat(list_concat(
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'd:' || array_to_string(list_slice(string_split(host, '.'), i, 999), '.')),
      list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1), lambda i: 'p:' || host || '/' || array_to_string(list_slice(list_filter(string_split(path, '/'), lambda x: x <> ''), 1, i), '/'))),
      ['u:' || host || path || query])) AS key FROM p WHERE host IS NOT NULL),
f AS (SELECT s.list, s.allow, s.key, s.day, s.until, (SELECT max(t.day) FROM s t WHERE t.list = s.list AND t.key = s.key AND t.listed AND t.day <= s.day
        AND NOT coalesce((SELECT u.listed FROM s u WHERE u.list = t.list AND u.key = t.key AND u.day < t.day ORDER BY u.day DESC LIMIT 1), false)) since FROM s WHERE s.listed),
m AS (SELECT k.url, k.fetched, f.*, row_number() OVER (PARTITION BY k.url, k.fetched ORDER BY substr(f.key, 1, 1) DESC, length(f.key) DESC, f.allow DESC, f.list DESC) n,
        count(*) OVER (PARTITION BY k.url, k.fetched) c
      FROM k JOIN f ON k.key = f.key AND k.fetched >= f.day AND (f.until IS NULL OR k.fetched < f.until))
SELECT p.page_id, p.url, p.fetched, p.host,
  CASE WHEN m.key IS NULL THEN 'none' WHEN m.allow THEN 'allow' ELSE 'block' END AS verdict,
  m.key AS matched_key, m.list AS matched_list, m.since AS listed_from, coalesce(m.c, 0)::BIGINT AS n_active
FROM p LEFT JOIN m ON p.url = m.url AND p.fetched = m.fetched AND m.n = 1
"""
