"""URL filters by a temporal list join.

Lists are dated events that add or remove an entry: a host with all hosts below it, or a host with the beginning of its
path, segment by segment. An entry's events become validity intervals, each lasting until the entry's next event, and
every capture is evaluated against the entries active at its fetch time by an as-of join on the entry's key.

Scale: captures are first reduced to distinct (URL, time); each gives one key per level of its host and path, down to
the deepest level that the lists hold, so the join is an equi-join on the key with the interval as its condition.
Intervals are broadcast only up to BROADCAST_ROWS; beyond, both sides are salted, so a host with a third of all captures
spreads over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

BROADCAST_ROWS = 200_000
SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, key, since, until (null: still active) of dated events (list, kind, key, action, day).

    kind: `host` or `path`; action: `add` or `remove`. Of events of one entry on one day a removal wins; an addition of
    an active entry begins a new interval. Events with a null in list, kind, key or day are left out.
    """
    key = ["list", "kind", "key"]
    once = events.dropna(subset=[*key, "day", "action"]).groupBy(*key, "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy(*key).orderBy("day"))
    return once.withColumn("until", until).filter("action = 'add'").select(*key, F.col("day").alias("since"), "until")


def _keys(hosts: int, segments: int):
    """Array of structs (kind, key) of a capture's host and path, down to the given depths."""
    host, path = F.lower(F.regexp_extract("url", HOST, 1)), F.regexp_extract("url", PATH, 1)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    below = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, hosts)))), lambda n: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("key")))
    deep = F.least(F.size(steps), F.lit(segments))
    begins = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda n: F.struct(F.lit("path").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")).alias("key"))))
    return F.when(host != "", F.concat(below, F.coalesce(begins, F.array().cast("array<struct<kind:string,key:string>>"))))


def evaluate(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """page_id, url, fetched, n_hits, lists: for every capture the entries active when it was fetched.

    `lists` has the names of the lists hit, sorted and joined by commas, null without a hit. An entry is active from the
    day of its addition until before its next event. Null or unreadable URLs and null times have no hits; repeated rows
    give a row each; an empty list or table is allowed; other columns are ignored.
    """
    spans = written(intervals(events), "intervals")
    depth = spans.agg(F.max(F.when(F.col("kind") == "host", F.size(F.split("key", r"\.")))).alias("h"), F.max(F.when(F.col("kind") == "path", F.size(F.split("key", "/")) - 1)).alias("p"), F.count("*").alias("n")).first()
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("fetched"))
    once = rows.dropna(subset=["url", "fetched"]).select("url", "fetched").distinct()
    keyed = once.select("url", "fetched", F.explode(_keys(depth.h or 0, depth.p or 0)).alias("k")).select("url", "fetched", "k.kind", "k.key")
    if depth.n <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(spans), ["kind", "key"])
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("url", "fetched"), F.lit(SALTS)).cast("int")).join(salted, ["kind", "key", "salt"])
    hits = joined.filter((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    found = hits.groupBy("url", "fetched").agg(F.count("*").alias("n_hits"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    # Captures of one URL and time are spread by salt, the few found are repeated for each.
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(found, ["url", "fetched", "salt"], "left").select("page_id", "url", "fetched", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "lists")
