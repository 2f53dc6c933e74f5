"""Sinks: append, upsert and export. Spark's commit protocol makes each write atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderflow.operators.arb import top_per_group


def append_by_day(df: DataFrame, path: str, ts: str = "timestamp", sort: str = "token_id", buckets: int = 0) -> None:
    """Appends rows partitioned by day and sorted within, which stands for an index on (time, token). With buckets a day
    is cut by the token too, so that one busy day is no single task and a search for tokens lists few folders."""
    from ladderflow.sources.readers import BUCKET, token_bucket

    day = df.withColumn("date", F.try_to_timestamp(F.col(ts).cast("string")).cast("date"))
    by = ["date"]
    if buckets:
        by.append(f"{BUCKET}{buckets}")
        day = day.withColumn(by[1], token_bucket(F.col(sort), buckets))
    day.repartition(*by).sortWithinPartitions(*by, ts, sort).write.mode("append").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row of each key, that of the highest version; new rows win ties. Write it over the old table."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return top_per_group(both, key, [F.desc(version), F.desc("_new")]).drop("_new")


def expire(df: DataFrame, now, seconds: float, ts: str = "ts") -> DataFrame:
    """Rows younger than the lifetime."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return df.where(age <= seconds * 1e6)


def queue_append(queue: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows that are not queued yet, once each."""
    return new.dropDuplicates(keys).join(queue.select(*keys), keys, "left_anti")


def to_csv(df: DataFrame, path: str, percent: list[str] = ()) -> None:
    """CSV with a header; numbers stay numbers in the frame and become percent text only here."""
    columns = [F.concat(F.format_number(F.col(c), 2), F.lit("%")).alias(c) if c in percent else F.col(c) for c in df.columns]
    df.select(*columns).write.mode("append").csv(path, header=True)


def to_json_lines(df: DataFrame, path: str, event_type: str, level: str = "INFO", ts: str = "ts") -> None:
    """Structured log lines of time, level, type and data."""
    data = F.struct(*[c for c in df.columns if c != ts])
    df.select(F.col(ts).cast("string").alias("timestamp"), F.lit(level).alias("level"), F.lit(event_type).alias("event_type"), data.alias("data")).write.mode("append").json(path)


def mapping_rows(links: DataFrame) -> DataFrame:
    """Link rows with ids as text and one id chosen among the alternatives."""
    return links.select(
        F.coalesce("condition_id", "id").cast("string").alias("market_id"), F.col("event_id").cast("string").alias("exchange_id"), F.col("selection_id").cast("string").alias("selection_id"), "confidence", "source",
    )


def compact_dictionary(aliases: DataFrame, garbage) -> DataFrame:
    """Dictionary rows (sport, canonical, alias, pos) without garbage aliases and with one alias of each folded form, the
    first. A canonical name that loses all aliases goes."""
    from ladderflow.functions.text import fold_accents

    kept = aliases.where(~garbage).withColumn("_form", fold_accents(F.lower(F.trim("alias"))))
    return top_per_group(kept, ["sport", "canonical", "_form"], ["pos"]).drop("_form")


def cache_put(cache: DataFrame, new: DataFrame, ttl: float) -> DataFrame:
    """The semantic cache (hash, query, embedding, data, stamp, ttl) with new answers (query, embedding, data, stamp); an
    answer replaces the one of the same query."""
    keyed = new.select(F.md5(F.lower(F.trim("query"))).alias("hash"), "query", "embedding", "data", "stamp", F.lit(float(ttl)).alias("ttl"))
    return upsert(cache, keyed, "hash", "stamp")


def cache_live(cache: DataFrame, now) -> DataFrame:
    """The entries of a cache that have not outlived their ttl (seconds)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("stamp").cast("timestamp"))
    return cache.where(age <= F.col("ttl") * 1e6)


def trace_html(steps: DataFrame, path: str) -> None:
    """One HTML file of traces (name, passed, step, pos): passed ones first, then by name, with their steps as a list.
    The rows of a trace are gathered; the report as a whole is written in order by a range sort, never in one task."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = steps.groupBy("name", "passed").agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("s"))
    items = F.array_join(F.transform("s", lambda x: F.concat(F.lit("<li>"), safe(x["step"]), F.lit("</li>"))), "")
    state = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    html = F.concat(F.lit("<section class='"), F.lower(state), F.lit("'><h2>"), safe(F.col("name")), F.lit(" "), state, F.lit("</h2><ol>"), items, F.lit("</ol></section>"))
    one.orderBy(F.desc("passed"), "name").select(html.alias("value")).write.mode("overwrite").text(path)
