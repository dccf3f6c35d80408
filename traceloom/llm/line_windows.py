"""Repeated runs of lines: overlapping windows of consecutive lines, hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.session import materialize

SIZE = 3


def _window(lines: Column, i: Column, size: int) -> Column:
    inside = [F.get(lines, i + k) for k in range(size)]
    visible = F.regexp_like(F.concat(*inside), F.lit(r"[^\x20\x09-\x0D]"))
    return F.when(
        visible, F.struct(i.alias("at"), F.xxhash64(*inside).alias("h1"), F.xxhash64(F.lit(1), *inside).alias("h2"))
    )


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """`doc_id, text_hash, starts`: sorted first lines of windows that also start earlier.

    Lines are cut at "\\n" and compared as they are. Earlier is a smaller
    doc_id, then a smaller hash of the text (for ids that occur with several
    texts), then an earlier line; equal rows are the same place and don't repeat
    each other. Windows without a visible character don't count. A null doc_id
    comes before all others. Hashes have 128 bits.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines")).where(
        F.size("lines") >= size
    )
    every = F.transform(
        F.sequence(F.lit(0), F.size("lines") - size), lambda i: _window(F.col("lines"), i, size)
    )
    windows = materialize(
        lines.select("doc_id", "text_hash", F.explode(every).alias("w"))
        .where("w IS NOT NULL")
        .select("doc_id", "text_hash", "w.*"),
        "windows",
    )
    place = F.struct("doc_id", "text_hash", "at")
    first = (
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    )
    later = windows.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def drop_repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """All rows and columns of `docs`, `text` without repeated windows, and counts.

    Every line that a repeated window covers goes, so overlapping windows are
    removed as one run. Added are `n_lines` and `n_removed` (under these names
    whatever `docs` has). A null text stays null and has no lines; an empty one
    is one empty line. A text whose lines all go becomes empty.
    """
    plain = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    found = repeated_windows(plain, size).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "starts")
    same = plain.doc_id.eqNullSafe(F.col("d")) & (F.xxhash64(plain.text) == F.col("h"))
    joined = plain.join(found, same, "left").select(
        "row", "text", "starts", F.split("text", "\n").alias("lines"), F.size("starts").alias("found")
    )
    lines, starts = F.col("lines"), F.col("starts")
    n = F.coalesce(F.when(lines.isNotNull(), F.size(lines)), F.lit(0))
    low, high = F.element_at(starts, 1), F.element_at(starts, -1)
    between = F.zip_with(
        F.slice(starts, 1, F.col("found") - 1),
        F.slice(starts, 2, F.col("found") - 1),
        lambda a, b: F.slice(lines, a + size + 1, F.greatest(b - a - size, F.lit(0))),
    )
    kept = F.concat(
        F.slice(lines, F.lit(1), low), F.flatten(between), F.slice(lines, high + size + 1, F.size(lines) - high - size)
    )
    rest = joined.select("row", "text", n.alias("n"), F.when(F.col("found") > 0, kept).alias("kept"))
    columns = {c: F.col(f"row.`{c}`").alias(c) for c in docs.columns}
    columns["text"] = F.coalesce(F.array_join("kept", "\n"), F.col("text")).alias("text")
    columns["n_lines"] = F.col("n").cast("long").alias("n_lines")
    columns["n_removed"] = F.when(F.col("kept").isNotNull(), F.col("n") - F.size("kept")).otherwise(0).cast("long").alias("n_removed")
    return rest.select(*columns.values())
