"""Requests to an owner, made of the last check; sending is out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_DAYS = 365


def requests(checks: DataFrame, errors: DataFrame, today: str) -> DataFrame:
    """(check, outcome, errors) of checks (check, status, date, expires) and errors (check, next, rule, from, to, file, line).

    outcome: `no verdict` of an unknown status, `nothing to ask` where no error's next step is a command, `bad date` where
    expires is not after both the check's day and today or more than 365 days after today, else `request`.  errors
    holds those asked about, in order; null expires asks for no end."""
    asked = errors.where("next = 'command'").groupBy("check").agg(F.array_sort(F.collect_list(F.struct("file", "line", "rule", "from", "to"))).alias("errors"))
    start = F.greatest(F.col("date"), F.to_date(F.lit(today)))
    days = F.datediff("expires", F.to_date(F.lit(today)))
    fine = F.col("expires").isNull() | ((F.col("expires") > start) & (days <= MOST_DAYS))
    outcome = F.when(F.col("status") == "unknown", "no verdict").when(F.col("errors").isNull(), "nothing to ask").when(~fine, "bad date").otherwise("request")
    rows = checks.join(asked, "check", "left").withColumn("outcome", outcome)
    return rows.select("check", "outcome", F.when(F.col("outcome") == "request", F.col("errors")).alias("errors"))
