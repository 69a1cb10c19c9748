"""Layout blocks: annotation joins, text of overlapping cells, neighbours, diverse page samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions import text as T
from pagelode.functions.text import PAGE, overlap_ratio


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x", "y", "w", "h")}


def mapped(annotations: DataFrame, mapping: DataFrame, on: str = "source_label", include_ignored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(annotations with their mapping, annotations whose label has none). Ignored targets, and uncertain ones not for training, are dropped, whatever their case and white space; null counts as ''."""
    known = annotations.join(mapping, on, "left_anti")
    out = annotations.join(mapping, on)
    if not include_ignored:
        word = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
        skip = word("target_label").isin("ignore", "ignored") | ((word("use_for_training") == "no") & word("target_label").isin("uncertain", "unknown"))
        out = out.where(~skip)
    return out, known


#: What became of a region's text.
MISSING, INVALID, UNPARSED, NO_OVERLAP, OVERLAP = "missing_text_cells", "invalid_text_cells_json", "text_cells_unparsed", "text_cells_no_overlap_todo_bbox_alignment", "text_cells_overlap_v1"


def text_of_regions(regions: DataFrame, cells: DataFrame, page: str = "page_id", region: str = "region_id", least: float = 0.2, payloads: DataFrame | None = None, payload: str = "payload") -> DataFrame:
    """page, region, text, text_status: text of the cells that lie in a region by ``least`` of their area, in (y, x, text) order.

    The page is an equi-key, so the overlap is a residual condition of a hash or
    merge join. payloads (page, payload) are the files that the cells were read
    from: a page without one, one that is no JSON, one without cells and one whose
    cells miss the region differ in status. Without payloads a page that has no
    cells counts as one without a file.
    """
    c = cells.select(page, F.col("text").alias("_text"), *[F.col(k).alias(f"c_{k}") for k in "xywh"])
    hit = regions.select(page, region, *"xywh").join(c, page).where(overlap_ratio(box(), box("c_")) >= least)
    words = F.array_sort(F.collect_list(F.struct(F.col("c_y").alias("y"), F.col("c_x").alias("x"), F.col("_text").alias("text"))))
    text = hit.groupBy(page, region).agg(F.array_join(F.transform(words, lambda t: t["text"]), " ").alias("text"))
    seen = cells.groupBy(page).agg(F.lit(True).alias("_seen"))
    if payloads is not None:
        sound = payloads.groupBy(page).agg(F.max(F.try_parse_json(payload).isNotNull()).alias("_sound"))
        seen = sound.join(seen, page, "left")
    else:
        seen = seen.withColumn("_sound", F.lit(True))
    out = regions.select(page, region).join(text, [page, region], "left").join(seen, page, "left")
    status = (
        F.when(F.col("text").isNotNull(), OVERLAP).when(F.col("_sound").isNull(), MISSING).when(~F.col("_sound"), INVALID).when(F.col("_seen").isNull(), UNPARSED).otherwise(NO_OVERLAP)
    )
    return out.select(page, region, F.coalesce("text", F.lit("")).alias("text"), status.alias("text_status"))


def neighbours(regions: DataFrame, page: str = "page_id", group: str = "page_id", order: Sequence[str] = ("y", "x", "seq"), size: float = PAGE) -> DataFrame:
    """regions with prev_ and next_ features. ``group`` is what the order runs through; a neighbour counts only on the same page."""
    w = W.partitionBy(group).orderBy(*order)
    me = F.struct(F.col(page).alias("page"), *"xywh", "text")
    out = regions
    for side, other in (("prev", F.lag(me).over(w)), ("next", F.lead(me).over(w))):
        out = out.withColumn(f"_{side}", F.when(other["page"] == F.col(page), other))
    x, y, w_, h = (F.col(k) for k in "xywh")
    for side in ("prev", "next"):
        o = F.col(f"_{side}")
        gap = F.when(o["y"] >= y, F.greatest(F.lit(0.0), o["y"] - (y + h))).otherwise(F.greatest(F.lit(0.0), y - (o["y"] + o["h"])))
        out = (
            out.withColumn(f"{side}_gap", F.bround(F.when(o.isNull(), F.lit(1.0)).otherwise(F.least(gap / size, F.lit(1.0))), 6))
            .withColumn(f"{side}_width_ratio", F.bround(F.when(o.isNotNull() & (w_ > 0), o["w"] / w_).otherwise(F.lit(0.0)), 6))
            .withColumn(f"{side}_text_len", F.bround(F.when(o.isNotNull(), F.least(F.length(o["text"]) / 200.0, F.lit(1.0))).otherwise(F.lit(0.0)), 6))
            .withColumn(f"{side}_same_left_band", F.coalesce(F.abs(o["x"] - x) / size <= 0.03, F.lit(False)))
        )
    ends = F.coalesce(F.rtrim(F.col("_prev")["text"]).endswith("."), F.lit(False))
    starts = F.coalesce(F.col("_next")["text"].rlike(r"^\s*([-*•]|\(?\d+[).]|[A-Za-z][).])\s+"), F.lit(False))
    return out.withColumn("prev_ends_period", ends).withColumn("next_starts_marker", starts).drop("_prev", "_next")


#: The columns of feature tables, in order.
FEATURES_V1 = """sample_id source_dataset source_page_id source_region_id page_no source_label target_label split text notes bbox_x_norm bbox_y_norm bbox_w_norm bbox_h_norm bbox_area_norm bbox_aspect_ratio
near_top near_bottom near_left near_right center_band page_no_norm text_missing text_len word_count avg_word_len digit_ratio upper_ratio lower_ratio punct_ratio space_ratio alpha_ratio title_token_ratio all_caps_ratio
starts_bullet starts_numbered ends_colon ends_period contains_url contains_email contains_pipe contains_tabular_hint contains_figure_hint contains_table_hint contains_form_hint contains_page_hint has_long_token
has_many_digits short_text very_short_text long_text""".split()
FEATURES_V2 = """feature_set token_count starts_with_alpha_marker no_terminal_period has_terminal_period title_case_short all_caps_short section_number_prefix contains_table_delimiters left_indent_bucket relative_x_bucket
relative_width_bucket y_position_bucket short_line_with_marker continuation_indent_like list_marker_type prev_gap_norm next_gap_norm prev_same_left_band next_same_left_band prev_width_ratio next_width_ratio
prev_text_len_norm next_text_len_norm prev_ends_period next_starts_marker""".split()


def feature_table(rows: DataFrame, version: int = 2) -> DataFrame:
    """The feature table of adapter rows (sample_id, source_page_id, page_no, bbox, text, ...), as cells of text: ratios with six places, flags 1 and 0.

    Neighbours are those in (page_no, y, x) order on the same page, so rows are
    ordered within a page number; ties go by a column ``seq`` if there is one, then by
    size and text; a page number that is none counts as 0.
    """
    parts = F.transform(F.split("bbox", ","), lambda v: F.trim(v).cast("double"))
    page = F.coalesce(F.expr("try_cast(page_no as double)"), F.lit(0.0))
    at = rows.withColumn("_b", parts).select(*rows.columns, *[F.get("_b", F.lit(i)).alias(k) for i, k in enumerate("xywh")], page.alias("_page"))
    order = ("y", "x", *["seq"] * ("seq" in rows.columns), "w", "h", "text", "source_page_id")  # ties by what the rows hold, not by where they lie
    around = neighbours(at, page="source_page_id", group="_page", order=order)
    text = T.text_features(F.col("text"))
    place = T.geometry_features(*[F.col(k) for k in "xywh"], F.col("_page"), text["word_count"], text["list_marker_type"])
    beside = {f"{s}_{k}{n}": F.col(f"{s}_{k}") for s in ("prev", "next") for k, n in (("gap", "_norm"), ("width_ratio", ""), ("text_len", "_norm"), ("same_left_band", ""))}
    found = {**text, **place, **beside, "prev_ends_period": F.col("prev_ends_period"), "next_starts_marker": F.col("next_starts_marker"), "ends_period": text["has_terminal_period"], "feature_set": F.lit(f"baseline_v{version}")}
    given = ("sample_id", "source_dataset", "source_page_id", "source_region_id", "page_no", "source_label", "target_label", "split", "text", "notes")
    names = [*FEATURES_V1, *FEATURES_V2 * (version == 2)]
    typed = around.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in given], *[found[c].alias(c) for c in names if c not in given])
    kinds = dict(typed.dtypes)

    def cell(name: str) -> Column:
        if kinds[name] == "boolean":
            return F.when(F.col(name), "1").otherwise("0")
        return F.format_string("%.6f", F.col(name)) if kinds[name] == "double" else F.col(name).cast("string")

    return typed.select(*[cell(c).alias(c) for c in names])


def diverse_sample(pages: DataFrame, sizes: dict[str, int], seed: int = 17) -> DataFrame:
    """split, page_id, step: pages chosen one after another so that rare labels and categories come first.

    pages: split, page_id, category, labels, n_annotations, ordered within a split by page_id. A step takes the page with the
    most 1/(1 + times chosen) over its labels, plus a quarter of that for its category and a little for its annotations; the
    first in a seeded shuffle wins ties. A split's pages are one group: it is a table of pages to choose from, not of documents.
    """
    order = {s: i for i, s in enumerate(sizes)}

    def run(pdf):
        import random
        from collections import Counter

        import pandas as pd

        split = pdf["split"].iloc[0]
        rows = pdf.sort_values("page_id").to_dict("records")
        rows = [r for r in rows if len(r["labels"])]
        random.Random(seed + 17 * order.get(split, 0)).shuffle(rows)
        labels, categories, out = Counter(), Counter(), []
        for step in range(min(sizes.get(split, 0), len(rows))):
            worth = lambda r: sum(1 / (1 + labels[x]) for x in sorted(r["labels"])) + 0.25 / (1 + categories[r["category"]]) + 0.001 * min(r["n_annotations"], 25)
            at = max(range(len(rows)), key=lambda i: (worth(rows[i]), -i))
            chosen = rows.pop(at)
            labels.update(chosen["labels"])
            categories[chosen["category"]] += 1
            out.append((split, chosen["page_id"], step))
        return pd.DataFrame(out, columns=["split", "page_id", "step"])

    return pages.select("split", "page_id", "category", "labels", "n_annotations").groupBy("split").applyInPandas(run, "split string, page_id long, step int")


def text_cells(payloads: DataFrame, key: str = "page_id", payload: str = "payload") -> DataFrame:
    """key, text, x, y, w, h: every node of any JSON that has a text and a box; a node and those below it may both be cells."""

    def boxed(value) -> tuple | None:
        keys = (("x", "y", "w", "h"), ("left", "top", "width", "height"))
        if isinstance(value, list) and len(value) == 4:
            parts = value
        elif isinstance(value, dict):
            parts = next(([value[k] for k in ks] for ks in keys if all(k in value for k in ks)), None)
            if parts is None and all(k in value for k in ("x0", "y0", "x1", "y1")):
                corner = [value[k] for k in ("x0", "y0", "x1", "y1")]
                parts = [*corner[:2], corner[2] - corner[0], corner[3] - corner[1]] if all(isinstance(v, int | float) for v in corner) else None
        else:
            parts = None
        return tuple(map(float, parts)) if parts and all(isinstance(v, int | float) and not isinstance(v, bool) for v in parts) else None

    def walk(node) -> Iterator[tuple]:
        todo = [node]
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                text = next((node[k].strip() for k in ("text", "content", "token", "value") if isinstance(node.get(k), str) and node[k].strip()), None)
                where = boxed(next((node[k] for k in ("bbox", "box", "rect", "bounding_box") if k in node), node))
                if text and where:
                    yield (text, *where)
            todo += reversed(list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else [])

    def run(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa

        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(k, *cell) for cell in walk(json.loads(text or "null"))]
                except ValueError:
                    continue  # its status is for the reader of the payload column to give
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), *[pa.float64()] * 4))], ["key", "text", "x", "y", "w", "h"])

    return payloads.select(F.col(key).cast("long").alias("key"), F.col(payload).cast("string")).mapInArrow(run, "key long, text string, x double, y double, w double, h double").withColumnRenamed("key", key)
