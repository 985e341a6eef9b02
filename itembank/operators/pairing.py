"""Question files and answer files to sets. Files: file_id, name, seq (order of arrival). Null names have a null key and pair with nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import pairing_key


def dedupe_files(files: DataFrame) -> DataFrame:
    """files with accepted: the first of each name, case aside."""
    rank = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("seq", "file_id"))
    return files.withColumn("accepted", rank == 1)


def pair_files(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """question_id, pair_key, answer_id, status: the k-th question file of a key takes its k-th answer file."""
    nth = F.row_number().over(Window.partitionBy("pair_key").orderBy("seq", "file_id"))
    side = lambda df, name: df.withColumn("pair_key", pairing_key(F.col("name"))).withColumn("nth", nth).select("pair_key", "nth", F.col("file_id").alias(name))
    pairs = side(questions, "question_id").join(side(answers, "answer_id"), ["pair_key", "nth"], "left")
    return pairs.select("question_id", "pair_key", "answer_id", F.when(F.col("answer_id").isNull(), "unmatched").otherwise("matched").alias("status"))


def pair_leftover(pairs: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """pairs, where the first question file that found nothing takes the first answer file left over."""
    free_q = questions.join(pairs.where("status = 'unmatched'").select(F.col("question_id").alias("file_id")), "file_id", "left_semi")
    free_a = answers.join(pairs.where("answer_id is not null").select(F.col("answer_id").alias("file_id")), "file_id", "left_anti")
    first = lambda df: df.agg(F.min(F.struct("seq", "file_id"))["file_id"].alias("file_id"))
    extra = first(free_q).select(F.lit(1).alias("k"), F.col("file_id").alias("question_id")).join(first(free_a).select(F.lit(1).alias("k"), F.col("file_id").alias("extra")), "k").drop("k")
    answer = F.coalesce("answer_id", "extra")
    out = pairs.join(F.broadcast(extra), "question_id", "left").withColumn("answer_id", answer).drop("extra")
    return out.withColumn("status", F.when(F.col("answer_id").isNull(), "unmatched").otherwise("matched"))
