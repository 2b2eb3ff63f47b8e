"""How many records hold each word of a name, and the weight that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelode.functions import names as nm
from namelode.functions.scoring import token_weight
from namelode.operators.retrieval import variants


def record_tokens(records: DataFrame, names: DataFrame) -> DataFrame:
    """(record_id, token): the distinct content words, without articles, of the names of active records."""
    active = records.filter("active_status = 'Active'").select(F.col("id").alias("record_id"))
    each = variants(names.join(active, "record_id", "left_semi"))
    words = nm.content_tokens(nm.tokenize(nm.normalize(F.col("name"))))
    rows = each.select("record_id", F.explode(words).alias("word"))
    return rows.select("record_id", nm.strip_article(F.col("word")).alias("token")).filter("token <> ''").distinct()


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(token, df): the number of records that hold each token."""
    return tokens.groupBy("token").agg(F.count("*").alias("df"))


def documents(tokens: DataFrame) -> DataFrame:
    """(documents): one row, the number of records that hold any token."""
    return tokens.agg(F.countDistinct("record_id").alias("documents"))


def weights(tokens: DataFrame) -> DataFrame:
    """(token, df, weight): each token with its weight by the share of records that hold it."""
    counted = document_frequencies(tokens).join(F.broadcast(documents(tokens)))
    return counted.select("token", "df", token_weight(F.col("token"), F.col("df"), F.col("documents")).alias("weight"))
