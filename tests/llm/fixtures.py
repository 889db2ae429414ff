"""Small tables with the awkward rows: nulls, empty and long texts, repeats, other columns of clashing names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, id long, size long"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), 1, 2, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def saved(spark, tmp_path, **tables):
    """A folder of tables as the queries read them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
