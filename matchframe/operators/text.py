"""Keyword in context over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_in_context(docs: DataFrame, keyword: str, before: int = 1200, after: int = 2200, limit: int = 5, text: str = "text",
                       id_col: str = "doc_id") -> DataFrame:
    """Hits of a literal keyword (any case) with the text around them.

    The whole text is split at the keyword; the lengths of the pieces give the
    offsets. `n_hits` counts every hit, rows are the first `limit` per document.
    """
    if not keyword:
        raise ValueError("empty keyword")
    quoted = "(?iu)\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    size = len(keyword)
    hits = (docs.where(F.col(text).rlike(quoted))
            .select(id_col, F.col(text).alias("_text"), F.split(F.col(text), quoted, -1).alias("_parts"))
            .withColumn("n_hits", F.size("_parts") - 1))
    first = F.slice("_parts", 1, F.least(F.col("n_hits"), F.lit(limit)))
    # running offset: end of the last hit so far, and the list of hit starts
    state = F.aggregate(first, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts")), lambda acc, part: F.struct(
        (acc["end"] + F.length(part) + size).alias("end"),
        F.concat(acc["starts"], F.array(acc["end"] + F.length(part))).alias("starts")))
    rows = hits.select(id_col, "_text", "n_hits", F.posexplode(state["starts"]).alias("hit", "start"))
    begin = F.greatest(F.lit(0), F.col("start") - before)
    return rows.select(id_col, "n_hits", (F.col("hit") + 1).alias("hit"), "start",
                       F.col("_text").substr(begin + 1, F.col("start") + size + after - begin).alias("context"))
