"""URL filter by a temporal list join.

Dated list entries (block, allow or remove a pattern) become validity intervals: each holds until the
next entry of its pattern. A capture is looked up under all patterns that could cover its URL, as of its
fetch time, and the most specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, saved, small

#: Of entries of one pattern at one time, the last of these holds.
ACTIONS = ("remove", "allow", "block")


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, action, listed) as pattern, action, listed, until (null: for good).

    Entries with a null field or an unknown action are ignored; so are all but the strictest of one time.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    e = entries.select(F.lower(F.col("pattern")).alias("pattern"), F.col("action"), F.col("listed").cast("timestamp").alias("listed"))
    e = e.where(F.col("pattern").isNotNull() & F.col("listed").isNotNull() & (rank > 0)).withColumn("rank", rank)
    e = e.groupBy("pattern", "listed").agg(F.max_by("action", "rank").alias("action"))
    until = F.lead("listed").over(W.partitionBy("pattern").orderBy("listed"))
    return e.withColumn("until", until).where(F.col("action") != "remove")


def temporal_url_filter(captures: DataFrame, entries: DataFrame, most_bytes: int = BROADCAST_BYTES, a_part: int = 100_000) -> DataFrame:
    """Verdicts for captures (page_id, url, fetched) by entries (pattern, action, listed).

    A pattern is a domain (covers its subdomains) or host/segment (covers URLs of that host whose first
    path segment it is). Longer patterns win over shorter ones.

    Returns a row per capture: page_id, url, fetched, host, verdict ('block', 'allow' or 'none'),
    pattern and listed of the deciding entry (null if none).

    Null or unparsable url, or null fetched: verdict 'none'; a null page_id is returned as null. Repeated
    captures are judged alike; an empty list leaves all at 'none', an empty table gives no rows. URLs of
    any length are parsed whole. Other columns are ignored.

    A list of up to ``most_bytes`` is broadcast. A larger one is joined by key: keys of over ``a_part``
    captures are counted first, dropped if they are not listed, and else spread over as many parts as
    they need, with their entries repeated for each part.
    """
    c = captures.select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        F.col("url").cast("string").alias("url"),
        F.col("fetched").cast("timestamp").alias("fetched"),
    ).withColumn("host", F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit("")))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    keys = F.concat(domains, F.when(segment != "", F.array(F.concat_ws("/", F.col("host"), F.lower(segment)))).otherwise(F.array().cast("array<string>")))
    looked = c.where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).select("row", "fetched", F.explode(keys).alias("key"))
    listed = saved(intervals(entries), "intervals")
    size = 48 * listed.count() + (listed.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0)
    if size <= most_bytes:
        looked, listed = looked.withColumn("part", F.lit(0).cast("long")), F.broadcast(listed.withColumn("part", F.lit(0).cast("long")))
    else:
        known = listed.select(F.col("pattern").alias("key"), F.lit(True).alias("listed")).distinct()
        hot = saved(looked.groupBy("key").agg(F.ceil(F.count("*") / a_part).alias("parts")).where("parts > 1").join(known, "key", "left"), "hot")
        hot_here = small(hot, hot.count(), 128)
        looked = looked.join(hot_here, "key", "left").where("parts is null or listed").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))).drop("parts", "listed")
        listed = listed.join(hot_here.select(F.col("key").alias("pattern"), "parts"), "pattern", "left")
        listed = listed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    active = (
        looked.alias("l")
        .join(listed.alias("i"), (F.col("l.key") == F.col("i.pattern")) & (F.col("l.part") == F.col("i.part")) & (F.col("i.listed") <= F.col("l.fetched")) & (F.col("i.until").isNull() | (F.col("l.fetched") < F.col("i.until"))))
        .groupBy("row")
        .agg(F.max_by(F.struct("action", "pattern", "listed"), F.length("pattern")).alias("e"))
    )
    return c.join(active, "row", "left").select("page_id", "url", "fetched", "host", F.coalesce("e.action", F.lit("none")).alias("verdict"), F.col("e.pattern").alias("pattern"), F.col("e.listed").alias("listed"))
