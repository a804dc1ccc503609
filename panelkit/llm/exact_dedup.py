"""Exact duplicates by skew-safe combining, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.session import keep

# Map tasks are dealt over so many salts; a group has at most so many partial winners in the last stage.
SALTS = 32


def _content(text: str) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [body.alias("_body"), F.sha2(body, 256).alias("text_sha256"), F.xxhash64(body).alias("_check")]


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """Groups of identical texts: ``text_sha256, _check, keep_id, group_size``, one row for each text.

    Three stages, each of which groups by digest *and* full text, so different texts never merge:
    every map task combines its own rows, the partial groups of a digest are merged per salt, and the
    winners of the salts are combined. The salt is that of the map task, so a task sends one row for
    each of its texts however often it holds it, and a reducer gets at most ``salts`` rows for a text.
    All buffers are numbers, so both levels hash-aggregate.
    """
    rows = docs.select(F.col(key).alias("_id"), *_content(text))
    rows = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = rows.groupBy("text_sha256", "_check", "_body", "_salt").agg(
        F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n")
    )
    whole = merged.groupBy("text_sha256", "_check", "_body").agg(
        F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size")
    )
    return whole.drop("_body")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical byte for byte; a NULL text counts as empty. Of equal texts
    the row with the largest key is kept. Rows that repeat both key and text count in ``group_size``,
    and one of them is kept. NULL keys lose to all others; a group with NULL keys only has a NULL
    ``keep_id`` and one kept row. An empty table gives an empty result; other columns are ignored.

    The rows meet their group by digest and a second, independent hash, so the texts themselves are not
    moved again. They are stored once with a number of their own and a salt; a group is attached to each
    salt of it first, and to the rows of that salt then, so no join has a key with many rows, however
    many rows share a text or repeat each other.
    """
    same = ["text_sha256", "_check"]
    rows = docs.select(F.col(key).alias("_id"), *_content(text)).drop("_body")
    rows = keep(rows.withColumns({"_row": F.monotonically_increasing_id(), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts))}))
    # rows of one task may all be alike, so a task's rows get several salts too
    rows = rows.withColumn("_salt", F.col("_salt") * 4 + F.pmod("_row", F.lit(4)))
    best = F.max(F.struct(F.col("_id").isNotNull(), "_id", (-F.col("_row")).alias("_row")))
    salted = keep(rows.groupBy(*same, "_salt").agg(best.alias("_best")))
    first = salted.groupBy(*same).agg((-F.max("_best")["_row"]).alias("_first"))
    groups = exact_groups(docs, key, text, salts).join(first, same)
    groups = salted.select(*same, "_salt").join(groups, same)
    joined = rows.join(groups, [*same, "_salt"])
    return joined.select(
        F.col("_id").alias(key), "keep_id", "group_size", (F.col("_row") == F.col("_first")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_duplicates` keeps.

    The same three stages as in :func:`exact_groups`, whose groups carry the rest of their best row, so
    the rows that stay leave the last one whole and no join is needed. Of rows that repeat key and text
    but differ elsewhere, any one stays.
    """
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()])
    body, digest, check = _content(own[text])
    rest = [v for c, v in own.items() if c != text]
    row = F.struct(F.col(own[text]).isNull().alias("_none"), *rest)
    order = F.struct(F.col(own[key]).isNotNull(), F.col(own[key]))
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt")
    rows = named.select(body, digest, check, salt, row.alias("_row"), order.alias("_order"))
    same = ["text_sha256", "_check", "_body"]
    best = [F.max_by("_row", "_order").alias("_row"), F.max("_order").alias("_order")]
    kept = rows.groupBy(*same, "_salt").agg(*best).groupBy(*same).agg(best[0])
    whole = F.when(~F.col("_row")["_none"], F.col("_body"))
    return kept.select(*[(whole if c == text else F.col("_row")[v]).alias(c) for c, v in own.items()])
