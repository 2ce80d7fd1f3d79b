"""What kind of model a label speaks of: one name for the many that it goes by."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Domains in order of precedence, and what they are called.
DOMAIN_ALIASES = {
    "property": ("property", "real estate", "development", "hospitality", "entertainment venue", "venue development", "mixed-use", "mixed use", "corporate"),
    "mining": ("mining", "coal", "resources", "minerals"),
    "infrastructure": ("infrastructure", "railway", "rail", "rail transport", "rail infrastructure"),
}
BETWEEN = r"(?<=[a-z0-9])(?=[^a-z0-9])|(?<=[^a-z0-9])(?=[a-z0-9])"


def phrases(text: Column, most_words: int) -> Column:
    """The runs of up to so many words of a text, in lower case, as they stand (with what is between the words)."""
    tokens = F.split(F.lower(text), BETWEEN)
    runs = F.transform(tokens, lambda _, k: F.transform(F.sequence(F.lit(0), F.lit(most_words - 1)), lambda m: F.array_join(F.slice(tokens, k + 1, 2 * m + 1), "")))
    return F.array_distinct(F.filter(F.flatten(runs), lambda run: run.rlike(r"^[a-z0-9](?s:.*)[a-z0-9]$|^[a-z0-9]$")))


def with_domain(rows: DataFrame, label: str, aliases: dict[str, tuple[str, ...]] = DOMAIN_ALIASES) -> DataFrame:
    """rows with `domain`: the first domain of which the label holds an alias as whole words, else the label itself.

    Phrases of distinct labels meet aliases by equality, so a longer table of aliases costs no more for each label.
    """
    spark = rows.sparkSession
    listed = [(k, name, alias) for k, (name, own) in enumerate(aliases.items()) for alias in own]
    most = max((len(re.findall(r"[a-z0-9]+", alias)) for _, _, alias in listed), default=1)
    table = spark.createDataFrame(listed, "rank int, domain string, phrase string")
    labels = rows.select(F.col(label).alias("_label")).where("_label IS NOT NULL").distinct()
    met = labels.select("_label", F.explode(phrases(F.col("_label"), most)).alias("phrase")).join(table, "phrase")
    known = met.groupBy("_label").agg(F.min_by("domain", "rank").alias("_domain"))
    return rows.join(known, rows[label] == known["_label"], "left").withColumn("domain", F.coalesce("_domain", F.col(label))).drop("_label", "_domain")
