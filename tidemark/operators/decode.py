"""Field edits worded through a dictionary table (F-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import words as W
from tidemark.session import broadcast_if_bounded


def decode_fields(fields: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``source, field, old, new`` -> ``phrase``. Of two rows for one column the first by label counts. A row for the table wins over one
    for any table; columns and codes it does not know stay as written. The dictionary is
    broadcast after its size is checked."""
    columns = dictionary.filter(F.col("kind") != "code").groupBy("file", "column").agg(F.min(F.struct("label", "unit")).alias("told"))
    columns = columns.select("file", "column", "told.label", "told.unit")
    codes = dictionary.filter(F.col("kind") == "code").groupBy("column", "code").agg(F.min_by("label", F.struct(F.col("file") == "", "file")).alias("meaning"))
    columns, codes = broadcast_if_bounded(columns), broadcast_if_bounded(codes)
    any_table = columns.filter(F.col("file") == "").select(F.col("column").alias("field"), F.col("label").alias("l0"), F.col("unit").alias("u0"))
    this_table = columns.filter(F.col("file") != "").select(F.col("file").alias("source"), F.col("column").alias("field"), F.col("label").alias("l1"), F.col("unit").alias("u1"))
    out = fields.join(any_table, "field", "left").join(this_table, ["source", "field"], "left")
    for side in ("old", "new"):
        code = codes.select(F.col("column").alias("field"), F.col("code").alias(side), F.col("meaning").alias(f"{side}_meaning"))
        out = out.join(code, ["field", side], "left")
    unit = F.coalesce("u1", "u0", F.lit(""))

    def say(side: str):
        v, m = F.col(side), F.col(f"{side}_meaning")
        coded = F.when(m.isNull(), v).when((F.upper(m) == F.upper(v)) | v.isin("Y", "N"), m).otherwise(W.text(m, " (", v, ")"))
        return F.when(v == "", "none").otherwise(coded)

    new = F.when((unit != "") & (F.col("new") != ""), W.text(say("new"), F.when(unit.startswith("°"), "").otherwise(" "), unit)).otherwise(say("new"))
    label = F.coalesce("l1", "l0", F.lower(F.regexp_replace("field", "_", " ")))
    return out.withColumn("phrase", W.text(label, ": ", say("old"), " -> ", new))
