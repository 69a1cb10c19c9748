"""Writers: fixed-order tables, JSON with its hash, logs, versioned results, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, fields: Sequence[str], single: bool = False, line_end: str = "\r\n") -> None:
    """Fields in the given order with a header. ``single`` writes one file and is for reports, not for data."""
    out = df.select(*fields)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("lineSep", line_end).csv(path)


def write_by(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """Parquet in a folder for each value; rows of a value are brought together first, so it gets few files."""
    df.repartition(*columns).write.mode(mode).partitionBy(*columns).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_versioned(df: DataFrame, path: str, stamp: str) -> None:
    """A new version beside the earlier ones; ``latest`` reads the newest of each key."""
    df.withColumn("check_ts", F.lit(stamp)).write.mode("append").partitionBy("check_ts").parquet(path)


def latest(df: DataFrame, key: Sequence[str], stamp: str = "check_ts") -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(stamp)).alias("_r")).select(*key, "_r.*")


def as_json(df: DataFrame) -> DataFrame:
    """json, sha256 of each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json")).withColumn("sha256", F.sha2("json", 256))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def error_report(scores: DataFrame, top: DataFrame, most: int = 5) -> str:
    """Markdown of per-label scores and commonest confusions; both tables are small reports."""
    lines = ["# Errors", "", "| label | support | precision | recall | f1 |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r['label']} | {r['support']} | {r['precision']:.4f} | {r['recall']:.4f} | {r['f1']:.4f} |" for r in scores.orderBy("label").collect()]
    lines += ["", "## Commonest confusions", ""] + [f"- {r['gold']} -> {r['pred']}: {r['n']}" for r in top.where(F.col("rank") <= most).orderBy("rank").collect()]
    return "\n".join(lines) + "\n"


def escaped(c: Column) -> Column:
    """Text as it stands in XML; null is empty."""
    out = F.coalesce(c, F.lit(""))
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def xhtml_form(tests: DataFrame, key: str = "path") -> DataFrame:
    """key, form: an ordered XHTML table of tests (pos, id, kind, title; category, subcategory and long where there are such columns), with a heading row wherever the category or subcategory changes."""
    has = lambda c: F.col(c) if c in tests.columns else F.lit(None).cast("string")
    w = W.partitionBy(key).orderBy("pos")
    rows = tests.select(
        key, "pos", "id", "kind", F.coalesce(has("long"), has("title"), has("short"), F.lit("")).alias("about"), F.coalesce(has("category"), F.lit("")).alias("category"), has("subcategory").alias("subcategory")
    )
    # what was shown last: categories change with each row, subcategories skip rows that have none
    shown = F.coalesce(F.last("subcategory", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(""))
    rows = rows.withColumn("_c", F.col("category") != F.coalesce(F.lag("category").over(w), F.lit(""))).withColumn("_s", F.coalesce(F.col("subcategory") != shown, F.lit(False)))
    heading = lambda flag, kind, c: F.when(F.col(flag), F.concat(F.lit(f'<tr class="{kind}"><td colspan="4">'), escaped(F.col(c)), F.lit("</td></tr>"))).otherwise("")
    cells = F.concat(
        F.lit('<tr id="'), escaped(F.col("id")), F.lit('"><td>'), escaped(F.col("id")), F.lit('</td><td class="type '), F.col("kind"), F.lit('">'), F.col("kind"), F.lit('</td><td><select name="sel-'), escaped(F.col("id")),
        F.lit('"/></td><td>'), escaped(F.col("about")), F.lit("</td></tr>"),
    )
    row = F.concat(heading("_c", "category", "category"), heading("_s", "subcategory", "subcategory"), cells)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "row")))
    return rows.withColumn("row", row).groupBy(key).agg(F.concat(F.lit("<table>"), F.array_join(F.transform(ordered, lambda r: r["row"]), ""), F.lit("</table>")).alias("form"))
