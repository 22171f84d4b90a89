"""Survey analytics: product severity, pain points, censuses, trends, alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claravoz.functions import dates, scoring, text

# Survey labels counted by the severity score.
DETRACTOR = "Detractor"
HIGH_CHURN = "Alto"
MEDIUM_CHURN = "Medio"


def _severity_columns(total: Column, detractors: Column, high: Column, medium: Column) -> dict[str, Column]:
    share = {
        "detractor_pct": detractors / total * 100,
        "high_churn_pct": high / total * 100,
        "medium_churn_pct": medium / total * 100,
    }
    score = scoring.severity_score(*share.values())
    return {**share, "severity_score": score, "severity_level": scoring.severity_level(score)}


def severity_by(df: DataFrame, by: Sequence[str], group: str = "NPS_GRUPO",
                churn: str = "churn_risk", more: Sequence[Column] = ()) -> DataFrame:
    """Counts, shares, severity score and level for each combination of ``by``; ``more``
    are further aggregates of the same pass."""
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_comments"),
        F.count_if(F.col(group) == DETRACTOR).alias("detractors"),
        F.count_if(F.col(churn) == HIGH_CHURN).alias("high_churn"),
        F.count_if(F.col(churn) == MEDIUM_CHURN).alias("medium_churn"), *more,
    )
    return counted.withColumns(_severity_columns(
        F.col("total_comments"), F.col("detractors"), F.col("high_churn"), F.col("medium_churn")
    ))


def top_pain_points(df: DataFrame, by: str = "plan", pain_point: str = "pain_points",
                    k: int = 5) -> DataFrame:
    """The k most frequent non-blank pain points per product: (by, pain_point, n, position).

    Counting comes first, so the ranking window sees one row per product and
    pain point. Ties go by name.
    """
    name = text.strip(F.col(pain_point))
    counted = (
        df.where(name != "").groupBy(by, name.alias("pain_point"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(by).orderBy(F.desc("n"), "pain_point")
    return counted.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def rank_products(df: DataFrame, by: str = "plan", group: str = "NPS_GRUPO",
                  churn: str = "churn_risk", pain_point: str = "pain_points", k: int = 5) -> DataFrame:
    """Severity ranking of products with their top pain points, most severe first."""
    severity = severity_by(df, [by], group, churn)
    tops = top_pain_points(df, by, pain_point, k).groupBy(by).agg(
        # at most k entries per product
        F.sort_array(F.collect_list(F.struct("position", "pain_point", "n"))).alias("_top")
    ).select(F.col(by).alias("_by"), F.transform(
        "_top", lambda t: F.struct(t["pain_point"].alias("pain_point"), t["n"].alias("n"))
    ).alias("top_pain_points"))
    ranked = severity.join(tops, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    # one row per product reaches the ranking window
    order = Window.orderBy(F.desc("severity_score"), by)
    return ranked.withColumn("rank", F.row_number().over(order)).orderBy("rank")


def ranking_sheet(ranking: DataFrame, by: str = "plan", shown: int = 3) -> DataFrame:
    """Report rows of the ranking: one decimal, and the top pain points as text."""
    def decimals(name: str, suffix: str = "") -> Column:
        return F.format_string("%.1f" + suffix, F.col(name))

    top = F.transform(
        F.slice(F.coalesce("top_pain_points", F.array()), 1, shown),
        lambda t: F.format_string("%s (%d)", t["pain_point"], t["n"]),
    )
    return ranking.select(
        "rank", F.col(by).alias("product"), "total_comments",
        decimals("detractor_pct", "%%").alias("detractors"),
        decimals("high_churn_pct", "%%").alias("high_risk"),
        decimals("medium_churn_pct", "%%").alias("medium_risk"),
        decimals("severity_score").alias("score"),
        F.array_join(top, ", ").alias("top_problems"),
    )


def pain_point_distribution(df: DataFrame, pain_point: str = "pain_points") -> DataFrame:
    """Count and share of every pain point over all products."""
    name = text.strip(F.col(pain_point))
    counted = (
        df.where(name != "").groupBy(name.alias("pain_point")).agg(F.count(F.lit(1)).alias("n"))
    )
    # the total is one row, so the join moves no names
    total = counted.agg(F.sum("n").alias("_total"), F.lit(1).alias("_one"))
    return counted.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
        "pain_point", "n", scoring.percent(F.col("n"), F.col("_total")).alias("pct"))


def spelling_census(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each raw spelling occurs in each column, with its boolean meaning."""
    cells = F.explode(F.array(*(
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("spelling")) for c in columns
    )))
    counted = df.select(cells.alias("s")).groupBy("s.field", "s.spelling").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.withColumn("meaning", text.normalize_boolean(F.col("spelling")))


def date_format_census(df: DataFrame, column: str) -> DataFrame:
    """How many values of a column are written in each date format."""
    return df.groupBy(dates.date_format_name(F.col(column)).alias("format")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(dates.parse_date(F.col(column), dates.EXTENDED_FORMATS)).alias("parsed"),
    )


def attack_census(df: DataFrame, column: str) -> DataFrame:
    """Rows per attack class in the raw text, with the share of non-null comments."""
    names = list(text.ATTACK_CLASSES)
    counts = df.agg(
        F.count(column).alias("total"),
        *(F.count_if(text.attack_flag(F.col(column), name)).alias(name) for name in names),
    )
    entries = F.explode(F.array(*(
        F.struct(F.lit(name).alias("attack"), F.col(name).alias("n")) for name in names
    )))
    return counts.select("total", entries.alias("e")).select(
        "e.attack", "e.n", scoring.percent(F.col("e.n"), F.col("total")).alias("pct")
    )


def sentiment_distribution(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """Rows per sentiment label."""
    return df.groupBy(sentiment).agg(F.count(F.lit(1)).alias("n"))


def task_statistics(records: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Per task: records, positive and negative results, average confidence.

    Of several results of a record the most confident counts, and of equally
    confident ones the last by label. Records are one row each.
    """
    one = sentiments.groupBy("record_id").agg(F.max(F.struct("confidence", "sentiment")).alias("_r")).select(
        "record_id", "_r.sentiment", "_r.confidence")
    joined = records.select("task_id", "record_id").distinct().join(one, "record_id", "left")
    return joined.groupBy("task_id").agg(
        F.count("record_id").alias("total_records"),
        F.count_if(F.col("sentiment") == "POSITIVE").alias("positive"),
        F.count_if(F.col("sentiment") == "NEGATIVE").alias("negative"),
        F.avg("confidence").alias("average_confidence"),
    )


def severity_trend(df: DataFrame, date: str, by: str = "plan", period: str = "month",
                   group: str = "NPS_GRUPO", churn: str = "churn_risk") -> DataFrame:
    """Severity per product and period, the change from the period before, and whether it got worse."""
    periods = df.withColumn("period", F.date_trunc(period, F.col(date)).cast("date"))
    severity = severity_by(periods, [by, "period"], group, churn)
    # one row per product and period reaches the window
    before = F.lag("severity_score").over(Window.partitionBy(by).orderBy("period"))
    trend = severity.withColumn("previous_score", before)
    change = F.col("severity_score") - F.col("previous_score")
    return trend.select(
        by, "period", "total_comments", "severity_score", "previous_score",
        change.alias("change"), F.coalesce(change > 0, F.lit(False)).alias("worsening"),
    )


def threshold_alerts(df: DataFrame, date: str, threshold: float = 40.0, by: str = "plan",
                     period: str = "week", group: str = "NPS_GRUPO",
                     churn: str = "churn_risk") -> DataFrame:
    """Periods in which a product's severity rises to the threshold or falls below it."""
    trend = severity_trend(df, date, by, period, group, churn)
    above = F.col("severity_score") >= threshold
    was_above = F.coalesce(F.col("previous_score") >= threshold, F.lit(False))
    return trend.where(above != was_above).select(
        by, "period", "severity_score", "previous_score",
        F.when(above, "raised").otherwise("cleared").alias("alert"),
    )


def issues_by_region(df: DataFrame, region: str = "region", group: str = "NPS_GRUPO",
                     churn: str = "churn_risk", pain_point: str = "pain_points") -> DataFrame:
    """Severity and number of named issues per region, rows without a region as one."""
    issues = F.count_if(text.strip(F.col(pain_point)) != "").alias("issues")
    return severity_by(df, [region], group, churn, [issues]).select(
        region, "total_comments", "issues", "severity_score", "severity_level"
    )


def agent_performance(df: DataFrame, agent: str = "agent_id", resolved: str = "fcr",
                      score: str = "NOTA") -> DataFrame:
    """Contacts, first-contact resolution rate and average score per agent."""
    return df.groupBy(agent).agg(
        F.count(F.lit(1)).alias("contacts"),
        F.avg(F.col(resolved).cast("int")).alias("resolution_rate"),
        F.avg(score).alias("average_score"),
    )


def preprocess_survey(df: DataFrame, keywords: Mapping[str, str] | None = None) -> DataFrame:
    """Documented cleaning of the survey table in one projection.

    Text fields stripped with nulls blank, four flags to two-valued booleans,
    comments cleaned, dates parsed, missing pain points filled from the comment.
    """
    blanks = ["plan", "NPS_GRUPO", "churn_risk", "region", "dispositivo", "sentimiento", "canal"]
    flags = ["outage_flag", "fcr", "sla_cumplido", "facturacion_flag"]
    types = {f.name: f.dataType for f in df.schema.fields}
    comment = text.clean_comment(F.col("comentario"))
    changed = {c: text.strip_or_blank(F.col(c)) for c in blanks if c in types}
    changed |= {c: text.two_valued_boolean(F.col(c), types[c]) for c in flags if c in types}
    changed["comentario"] = comment
    changed["fecha_parsed"] = dates.parse_date(F.col("fecha"), dates.SURVEY_FORMATS)
    changed["pain_points"] = text.fill_pain_point(F.col("pain_points"), comment, keywords)
    return df.withColumns(changed)
