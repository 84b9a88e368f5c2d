"""Search requests, their cache, hits, cost and request-rate audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# --- fixed values: request limits (seconds, requests), cost per query and life times in hours ---
RATE_LIMITS = ((60, 10), (3600, 300))
COST_PER_QUERY = (("bing", 0.003), ("serpapi", 0.005))
DISCOVERY_TTL_HOURS, SEARCH_TTL_HOURS = 24, 720


def cache_key(df: DataFrame, out: str = "cache_key") -> DataFrame:
    """md5 of the lower-cased person, lab and university."""
    text = F.lower(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("name", "lab_name", "university")]))
    return df.withColumn(out, F.md5(text))


def search_hit_score(hits: DataFrame) -> DataFrame:
    """Add ``score`` (thousandths) of each hit (url, title, snippet) for its person and lab."""
    url, title, snip = F.lower("url"), F.lower("title"), F.lower("snippet")
    # parts lose their title prefix by text, then blanks split them
    person = F.replace(F.replace(F.lower("name"), F.lit("dr. "), F.lit("")), F.lit("prof. "), F.lit(""))
    parts = F.filter(F.split(person, r"\s+"), lambda p: F.length(p) > 2)
    words = F.filter(F.split(F.lower(F.coalesce("lab_name", F.lit(""))), r"\s+"), lambda p: F.length(p) > 3)
    n_words = F.size(F.filter(words, lambda w: url.contains(w) | title.contains(w) | snip.contains(w)))
    score = (
        F.when(url.contains(".edu"), 400).when(url.contains(".org"), 200).otherwise(0)
        + F.when(F.exists(parts, lambda p: url.contains(p) | title.contains(p)), 300).otherwise(0)
        + F.least(F.lit(300), n_words * 100)
        + F.when(url.rlike("lab|laboratory|research|center|group"), 200).otherwise(0)
    )
    return hits.withColumn("score", score)


def age_hours(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, now) / F.lit(3.6e9)


def purge_expired(df: DataFrame, ts_col: str, ttl_hours: float, now: Column, keep: Column | None = None) -> DataFrame:
    """Rows younger than the life time, plus those that ``keep`` protects."""
    young = age_hours(F.col(ts_col), now) <= ttl_hours
    return df.filter(young | keep if keep is not None else young)


def cache_summary(df: DataFrame, ts_col: str, cost: Column, now: Column) -> DataFrame:
    """One row: entries, total cost, entries younger than a day, the rest."""
    fresh = age_hours(F.col(ts_col), now) < DISCOVERY_TTL_HOURS
    return df.agg(F.count("*").alias("entries"), F.round(F.sum(cost), 6).alias("total_cost"),
                  F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("old"))


def cache_split(requests: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = SEARCH_TTL_HOURS) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached result, misses). The newest unexpired entry of a key answers its requests."""
    alive = cache.filter((age_hours(F.col("cached_at"), now) <= ttl_hours) & (F.col("cached_at") <= now))
    newest = alive.groupBy("cache_key").agg(F.max_by("result", F.struct("cached_at", "result")).alias("result"))
    return requests.join(newest, "cache_key"), requests.join(newest.select("cache_key"), "cache_key", "left_anti")


def query_cost(log: DataFrame) -> DataFrame:
    """Per channel: queries, cost, answered and failed ones."""
    rate = F.lit(0.0)
    for ch, c in COST_PER_QUERY:
        rate = F.when(F.col("channel") == ch, c).otherwise(rate)
    return log.groupBy("channel").agg(
        F.count("*").alias("queries"), F.count_if(F.col("status_code") == 200).alias("answered"),
        F.count_if(F.col("status_code") != 200).alias("failed"),
    ).withColumn("cost", F.round(rate * F.col("queries"), 6)).withColumn("cheapest", F.col("channel") == COST_PER_QUERY[0][0])


def throttle_audit(log: DataFrame, limits=RATE_LIMITS, key: str = "host", ts: str = "ts", row_id: str = "fetch_id") -> DataFrame:
    """Requests in the trailing window of each limit, and whether they exceed it. Limits are whole seconds.

    A window by key would send one busy key to one task. The count of a row at time t over L seconds is therefore
    split at whole seconds: rows of its own second up to t, rows of the second L before from t - L on, and all rows of
    the seconds between. The last part needs only counts per (key, second), which are combined before the shuffle; the
    first two need groups of one key and one second. The sum is exact and no task sees more than that.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = log.select(row_id, key, ts, us.alias("_us"), F.floor(us / F.lit(1_000_000)).alias("_sec"))

    longest = max(s for s, _ in limits)
    own = F.floor(F.col("_sec") / F.lit(longest))
    per_sec = rows.groupBy(key, "_sec").agg(F.count("*").alias("_n"))
    # seconds are seen in their own stretch and, as context, in the next one
    seen = per_sec.select("*", own.alias("_own"), F.explode(F.array(own, own + 1)).alias("_part"))
    for seconds, _ in limits:
        w = W.partitionBy(key, "_part").orderBy("_sec").rangeBetween(-(seconds - 1), -1)
        seen = seen.withColumn(f"_full_{seconds}", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    full = seen.filter("_part = _own").select(key, "_sec", *[f"_full_{s}" for s, _ in limits])

    # rows of the second a limit ago are shifted into the second of the rows that count them
    none = F.lit(None)
    parts = rows.select(F.lit(0).alias("_kind"), row_id, key, ts, "_us", "_sec")
    for seconds, _ in limits:
        parts = parts.unionByName(rows.select(
            F.lit(seconds).alias("_kind"), none.cast(log.schema[row_id].dataType).alias(row_id), key, none.cast(log.schema[ts].dataType).alias(ts),
            (F.col("_us") + seconds * 1_000_000).alias("_us"), (F.col("_sec") + seconds).alias("_sec")))
    group = W.partitionBy(key, "_sec").orderBy("_us")
    upto = group.rangeBetween(W.unboundedPreceding, W.currentRow)
    onward = group.rangeBetween(W.currentRow, W.unboundedFollowing)
    ends = parts.withColumn("_mine", F.count_if(F.col("_kind") == 0).over(upto))
    for seconds, _ in limits:
        ends = ends.withColumn(f"_start_{seconds}", F.count_if(F.col("_kind") == seconds).over(onward))
    out = ends.filter("_kind = 0").join(full, [key, "_sec"])
    for seconds, limit in limits:
        n = F.col("_mine") + F.col(f"_start_{seconds}") + F.col(f"_full_{seconds}")
        out = out.withColumn(f"n_{seconds}s", n).withColumn(f"over_{seconds}s", F.col(f"n_{seconds}s") > limit)
    return out.select(row_id, key, ts, *[c for s, _ in limits for c in (f"n_{s}s", f"over_{s}s")])


# fixed values: per-domain delay in seconds, default, allowed and blocked hosts
HOST_DELAYS = (
    ("stanford.edu", 2.0), ("mit.edu", 2.0), ("harvard.edu", 2.0), ("cmu.edu", 1.5), ("berkeley.edu", 1.5), ("yale.edu", 2.0),
    ("princeton.edu", 2.0),
)
DEFAULT_DELAY = 1.0
ALLOWED_HOSTS = r"\.edu$|\.ac\.uk$|\.ac\.|^scholar\.google\.com$"
BLOCKED_HOSTS = r"(^|\.)(facebook|twitter|instagram)\.com$"


def host_policy(links: DataFrame, delays=HOST_DELAYS, default: float = DEFAULT_DELAY, host: str = "host") -> DataFrame:
    """Add ``delay`` (first configured domain contained in the host, else the default), ``allowed`` and ``blocked``.

    The policy is configuration, so it becomes one expression instead of a join.
    """
    h, delay = F.col(host), F.lit(default)
    for domain, seconds in reversed(delays):
        delay = F.when(h.contains(domain), seconds).otherwise(delay)
    return links.withColumns({"delay": delay, "allowed": h.rlike(ALLOWED_HOSTS), "blocked": h.rlike(BLOCKED_HOSTS)})
