"""Operators on text tables: lines, lexica, repeated headers, quality reports, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line) of every line; null texts have none."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def lexicon(titles: DataFrame, column: str) -> DataFrame:
    """(term): distinct parts of 2-12 characters with a Han character, brackets cut, of the given column."""
    bare = F.regexp_replace(column, "（[^）]*）|\\([^)]*\\)", "")
    parts = titles.select(F.explode(F.split(bare, "[、，,和与]")).alias("term")).select(F.trim("term").alias("term"))
    return parts.where("length(term) between 2 and 12 and term rlike '[㐀-鿿]'").distinct()


def repeated_headers(df: DataFrame, doc: str, page: str, text: str = "text", least: int = 3) -> DataFrame:
    """(doc, line): lines on at least `least` pages of a document that has as many pages."""
    each = df.where(F.col(text).isNotNull()).select(doc, page, F.explode(F.split(text, "\n", -1)).alias("line")).select(doc, page, F.trim("line").alias("line")).where("line <> ''").distinct()
    return each.groupBy(doc, "line").count().where(F.col("count") >= least).select(doc, "line")


def quality_report(df: DataFrame, source: str, text: str = "text", title: str = "title", doc: str = "source_id", accessed: str = "accessed_at") -> DataFrame:
    """Per source: rows, titles equal to the id, missing access dates, carriage returns, ASCII-dominant and short texts, mean length."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n"), F.count_if(F.col(title) == F.col(doc)).alias("title_equals_id"), F.count_if(F.coalesce(F.col(accessed), F.lit("")) == "").alias("accessed_missing"),
        F.count_if(F.instr(t, "\r") > 0).alias("cr"), F.count_if((F.length(t) >= 20) & (T.ascii_ratio(t) >= 0.8)).alias("ascii_dominant"), F.count_if(F.length(t) < 15).alias("short"),
        F.sum(F.length(t)).alias("chars"),
    )


def runs(df: DataFrame, by: list[str], order: str, flag: str, least: int) -> DataFrame:
    """Rows of df with `in_run`: whether the row lies in a run of at least `least` neighbouring flagged rows (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w)
    marked = df.withColumn("_island", island)
    size = F.sum(F.col(flag).cast("int")).over(Window.partitionBy(*by, "_island"))
    return marked.withColumn("in_run", F.col(flag) & (size >= least)).drop("_island")


def contained_questions(texts: DataFrame, questions: DataFrame, block: int = 24, least: int = 50) -> DataFrame:
    """(text_id, question_id): texts that contain a question of more than `least` characters verbatim.

    A containing text holds the question's first `block` characters; texts are cut into all their windows only where the window hash is one
    of a question's, so the join is an equi-join instead of one over all pairs."""
    q = questions.where(F.length("question") > least).select("question_id", "question", F.xxhash64(F.substring("question", 1, block)).alias("h"))
    cut = T.windows(F.col("text"), block)
    w = texts.where(F.length("text") > least).select("text_id", F.explode(F.array_distinct(F.transform(cut, lambda x: F.xxhash64(x)))).alias("h"))
    hit = w.join(q, "h").select("text_id", "question_id", "question")
    return hit.join(texts, "text_id").where(F.contains("text", F.col("question"))).select("text_id", "question_id").distinct()
