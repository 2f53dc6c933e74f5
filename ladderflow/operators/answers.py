"""Answers of language models, given as columns: what is asked, in which order, and what counts: F05, Y30."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderflow.functions.text import extract_json


def verdict(answer: Column) -> Column:
    """Struct (is_arb, confidence, reason) of a free answer: its JSON object, or the answer itself cut to 50 letters as a reason
    with a confidence of 0.3. Fields that the object lacks are false, 0 and a fixed text."""
    body = extract_json(answer)
    field = lambda name: F.get_json_object(body, f"$.{name}")
    found = F.struct(F.coalesce(field("is_arb") == "true", F.lit(False)).alias("is_arb"), F.coalesce(field("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(field("reason"), F.lit("Analysis complete")).alias("reason"))
    none = F.struct(F.lit(False).alias("is_arb"), F.lit(0.3).alias("confidence"), F.substring(F.coalesce(answer, F.lit("")), 1, 50).alias("reason"))
    return F.when(body.isNotNull(), found).otherwise(none)


def cascade(rows: DataFrame, least_ev: float = 0.5, yes: float = 0.7, no: float = 0.3, sure: float = 0.6) -> DataFrame:
    """rows (ev_net, cached, quick, deep) with is_opportunity, confidence, reasoning and source.

    A known expected value below the least ends the matter; else a cached answer counts; else the cheap model's Y or N, if it is
    a no that is surer than ``sure``; else the primary model's answer. With the given confidences of yes and no a no is never sure
    enough, so the primary answer always counts, as in the original; set ``no`` to let it decide. A missing quick answer counts as a yes
    of 0.5."""
    quick = F.upper(F.trim("quick"))
    is_yes = F.col("quick").isNull() | quick.contains("Y")
    confidence = F.when(F.col("quick").isNull(), 0.5).when(is_yes, yes).otherwise(no)
    made = lambda arb, conf, why, source: F.struct(arb.alias("is_opportunity"), conf.cast("double").alias("confidence"), why.alias("reasoning"), F.lit(source).alias("source"))
    cached, deep = verdict(F.col("cached")), verdict(F.col("deep"))
    low = F.col("ev_net") < least_ev
    out = (
        F.when(low, made(F.lit(False), F.lit(0.0), F.format_string("EV %.2f%% below threshold", "ev_net"), "math_filter"))
        .when(F.col("cached").isNotNull(), made(cached["is_arb"], cached["confidence"], cached["reason"], "cache"))
        .when(~is_yes & (confidence > sure), made(F.lit(False), F.lit(0.3), F.lit("Quick check negative"), "quick"))
        .otherwise(made(deep["is_arb"], deep["confidence"], deep["reason"], "primary"))
    )
    return rows.withColumn("_v", out).select(*rows.columns, "_v.*")
