"""Registered queries over the driver's tables, each with the DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import text as T
from pagelode.operators import check_results, documents, layout, manifests, metrics, models, relations
from pagelode.plans import ablation, block_rules, gate_oracle
from pagelode.schemas import ROW_KEY
from pagelode.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Text features

_COUNT = "length(t) - length(regexp_replace(t, '{}', '', 'g'))"
_R6 = "round_even(CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0 END, 6)"
_TEXT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS ts FROM documents),
c AS (SELECT *, length(t) AS n, len(ts) AS k, {_COUNT.format('\\p{L}')} AS alpha, {_COUNT.format('\\p{Nd}')} AS digit, {_COUNT.format('\\p{Lu}')} AS upper,
  {_COUNT.format('\\p{Ll}')} AS lower, {_COUNT.format('[\\s\\p{Z}]')} AS space, {_COUNT.format('[^\\p{L}\\p{N}\\s\\p{Z}]')} AS punct FROM d)
SELECT doc_id, n::BIGINT AS text_len, k::BIGINT AS word_count, {_R6.format("length(array_to_string(ts, ''))", 'k')} AS avg_word_len,
  {', '.join(f"{_R6.format(x, 'n')} AS {x}_ratio" for x in ('alpha', 'digit', 'upper', 'lower', 'space', 'punct'))},
  {_R6.format("len(list_filter(ts, lambda x: regexp_matches(x, '^[A-Z][^A-Z]*[a-z][^A-Z]*$')))", 'k')} AS title_token_ratio,
  {_R6.format("len(list_filter(ts, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))", 'k')} AS all_caps_ratio
FROM c
"""


@query(_TEXT)
def text_char_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.text_features(F.col("text"))
    names = ["text_len", "word_count", "avg_word_len", *[f"{x}_ratio" for x in ("alpha", "digit", "upper", "lower", "space", "punct")], "title_token_ratio", "all_caps_ratio"]
    return table(spark, sf_dir, "documents").select("doc_id", *[(found[n].cast("long") if n in ("text_len", "word_count") else found[n]).alias(n) for n in names])


_LINES = "SELECT doc_id, i - 1 AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)"


@query(f"WITH l AS ({_LINES}) SELECT doc_id, line_no::BIGINT AS line_no, length(line)::BIGINT AS n_chars, regexp_matches(line, '\\S') AS has_text FROM l")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"), F.col("line").rlike(r"\S").alias("has_text"))


_MARK = r"CASE WHEN regexp_matches(s, '^[-*•]\s+') THEN 1 WHEN regexp_matches(s, '^\(?\d+[).]\s+') THEN 2 WHEN regexp_matches(s, '^[A-Za-z][).]\s+') THEN 3 ELSE 0 END"
_FLAG_SQL = ", ".join(f"regexp_matches(line, '{p}') AS {n}" for n, p in T.FLAGS.items())


@query(f"""
WITH l AS ({_LINES}), s AS (SELECT *, regexp_replace(line, '^\\s+', '') AS s, regexp_extract_all(line, '[A-Za-z0-9]+') AS ts FROM l)
SELECT doc_id, line_no::BIGINT AS line_no, {_FLAG_SQL}, ({_MARK})::BIGINT AS list_marker_type, len(list_filter(ts, lambda x: length(x) >= 18)) > 0 AS has_long_token,
  len(ts) <= 4 AS short_text, len(ts) >= 30 AS long_text, len(ts) <= 6 AND ({_MARK}) > 0 AS short_line_with_marker FROM s
""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.text_features(F.col("line"))
    names = [*T.FLAGS, "has_long_token", "short_text", "long_text", "short_line_with_marker"]
    rows = documents.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), *[found[n].alias(n) for n in names], found["list_marker_type"].cast("long").alias("list_marker_type"))


_BOX = "(l_linenumber * 130)::DOUBLE AS x, (l_quantity * 18)::DOUBLE AS y, (60 + l_partkey % 90)::DOUBLE AS w, (10 + l_suppkey % 40)::DOUBLE AS h"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of line items: a page for each order."""
    rows = table(spark, sf_dir, "lineitem")
    d = lambda c: c.cast("double")
    return rows.select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("seq"), d(F.col("l_linenumber") * 130).alias("x"), d(F.col("l_quantity") * 18).alias("y"),
        d(60 + F.col("l_partkey") % 90).alias("w"), d(10 + F.col("l_suppkey") % 40).alias("h"), F.concat("l_returnflag", F.lit(". "), "l_linestatus", F.when(F.col("l_partkey") % 3 == 0, ".").otherwise("")).alias("text"),
    )


_REGIONS = f"SELECT l_orderkey AS page_id, l_linenumber::BIGINT AS seq, {_BOX}, l_returnflag || '. ' || l_linestatus || CASE WHEN l_partkey % 3 = 0 THEN '.' ELSE '' END AS text FROM lineitem"


@query(f"""
WITH r AS ({_REGIONS}) SELECT page_id, seq, round_even(x / 1025, 6) AS bbox_x_norm, round_even(y / 1025, 6) AS bbox_y_norm, round_even(w / 1025 * (h / 1025), 6) AS bbox_area_norm,
  round_even(w / h, 6) AS bbox_aspect_ratio, y / 1025 <= 0.15::DOUBLE AS near_top, (y + h) / 1025 >= 0.85::DOUBLE AS near_bottom, (x + w / 2) / 1025 BETWEEN 0.2::DOUBLE AND 0.8::DOUBLE AS center_band,
  (CASE WHEN x / 1025 <= 0.08::DOUBLE THEN 0 WHEN x / 1025 <= 0.16::DOUBLE THEN 1 WHEN x / 1025 <= 0.24::DOUBLE THEN 2 WHEN x / 1025 <= 0.32::DOUBLE THEN 3 ELSE 4 END)::BIGINT AS left_indent_bucket FROM r
""")
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.geometry_features(*[F.col(c) for c in "xywh"], F.lit(1.0), F.lit(4), F.lit(0))
    names = ("bbox_x_norm", "bbox_y_norm", "bbox_area_norm", "bbox_aspect_ratio", "near_top", "near_bottom", "center_band")
    return _regions(spark, sf_dir).select("page_id", "seq", *[g[n].alias(n) for n in names], g["left_indent_bucket"].cast("long").alias("left_indent_bucket"))


def _side(side: str, f: str) -> str:
    o = f"{f}({{}}) OVER w"
    x, y, w, h, t = (o.format(c) for c in ("x", "y", "w", "h", "text"))
    gap = f"CASE WHEN {y} IS NULL THEN 1.0 WHEN {y} >= y THEN least(greatest(0, {y} - (y + h)) / 1025, 1) ELSE least(greatest(0, y - ({y} + {h})) / 1025, 1) END"
    return f"round_even({gap}, 6) AS {side}_gap, round_even(coalesce({w} / w, 0), 6) AS {side}_width_ratio, round_even((CASE WHEN {t} IS NULL THEN 0 ELSE least(length({t}) / 200.0, 1) END)::DOUBLE, 6) AS {side}_text_len, coalesce(abs({x} - x) / 1025 <= 0.03::DOUBLE, FALSE) AS {side}_same_left_band"


@query(f"""
WITH r AS ({_REGIONS}) SELECT page_id, seq, {_side('prev', 'lag')}, {_side('next', 'lead')}, coalesce(ends_with(rtrim(lag(text) OVER w), '.'), FALSE) AS prev_ends_period,
  coalesce(regexp_matches(lead(text) OVER w, '^\\s*([-*•]|\\(?\\d+[).]|[A-Za-z][).])\\s+'), FALSE) AS next_starts_marker FROM r WINDOW w AS (PARTITION BY page_id ORDER BY y, x, seq, w, h, text)
""")
def neighbour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.neighbours(_regions(spark, sf_dir), order=("y", "x", "seq", "w", "h", "text")).drop("x", "y", "w", "h", "text")


_f6 = lambda x: f"printf('%.6f', {x})"
_b1 = lambda x: f"CASE WHEN {x} THEN '1' ELSE '0' END"
_GAP = "CASE WHEN {o}y IS NULL THEN 1.0::DOUBLE WHEN {o}y >= y THEN least(greatest(0, {o}y - (y + h)) / 1025, 1) ELSE least(greatest(0, y - ({o}y + {o}h)) / 1025, 1) END"


@query(f"""
WITH r AS ({_REGIONS}), a AS (SELECT *, page_id % 9 AS page_no, seq + page_id * 10 AS pos FROM r),
o AS (SELECT *, CASE WHEN lag(page_id) OVER w = page_id THEN {{'x': lag(x) OVER w, 'y': lag(y) OVER w, 'w': lag(w) OVER w, 'h': lag(h) OVER w, 't': lag(text) OVER w}} END AS p,
  CASE WHEN lead(page_id) OVER w = page_id THEN {{'x': lead(x) OVER w, 'y': lead(y) OVER w, 'w': lead(w) OVER w, 'h': lead(h) OVER w, 't': lead(text) OVER w}} END AS n FROM a WINDOW w AS (PARTITION BY page_no ORDER BY y, x, pos, w, h, text)),
c AS (SELECT *, p.y AS py, p.h AS ph, n.y AS ny, n.h AS nh FROM o)
SELECT 'r' || page_id || '-' || seq AS sample_id, {_f6('x / 1025')} AS bbox_x_norm, {_f6('w / 1025 * (h / 1025)')} AS bbox_area_norm, {_f6('w / h')} AS bbox_aspect_ratio, {_b1('y / 1025 <= 0.15::DOUBLE')} AS near_top, {_f6('least(page_no / 50.0::DOUBLE, 1)')} AS page_no_norm,
  length(text)::VARCHAR AS text_len, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::VARCHAR AS word_count, {_f6("(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::DOUBLE / length(text)")} AS upper_ratio, {_b1("ends_with(text, '.')")} AS ends_period,
  {_b1("NOT ends_with(text, '.')")} AS no_terminal_period, '3' AS list_marker_type, {_f6(_GAP.format(o='p'))} AS prev_gap_norm, {_f6(_GAP.format(o='n'))} AS next_gap_norm, {_f6('coalesce(p.w / w, 0)')} AS prev_width_ratio,
  {_f6('CASE WHEN n IS NULL THEN 0::DOUBLE ELSE least(length(n.t) / 200.0::DOUBLE, 1) END')} AS next_text_len_norm, {_b1("coalesce(abs(n.x - x) / 1025 <= 0.03::DOUBLE, FALSE)")} AS next_same_left_band, {_b1("coalesce(ends_with(p.t, '.'), FALSE)")} AS prev_ends_period, {_b1('n IS NOT NULL')} AS next_starts_marker FROM c
""")
def feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _regions(spark, sf_dir)
    rows = r.select(
        F.concat(F.lit("r"), "page_id", F.lit("-"), "seq").alias("sample_id"), F.lit("made").alias("source_dataset"), F.col("page_id").alias("source_page_id"), F.col("seq").alias("source_region_id"), (F.col("page_id") % 9).cast("string").alias("page_no"),
        F.concat_ws(", ", T.number_text(F.col("x")), T.number_text(F.col("y")), T.number_text(F.col("w")), T.number_text(F.col("h"))).alias("bbox"), F.lit("Text").alias("source_label"), F.lit("paragraph").alias("target_label"), F.lit("train").alias("split"), "text", F.lit(None).cast("string").alias("notes"),
        (F.col("seq") + F.col("page_id") * 10).alias("seq"),
    )
    shown = "sample_id bbox_x_norm bbox_area_norm bbox_aspect_ratio near_top page_no_norm text_len word_count upper_ratio ends_period no_terminal_period list_marker_type prev_gap_norm next_gap_norm prev_width_ratio next_text_len_norm next_same_left_band prev_ends_period next_starts_marker"
    return layout.feature_table(rows).select(*shown.split())


# Block rules


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the features that lines have; the others are dealt out by row number, nulls and cells of text among them, so that every rule is met."""
    return spark.sql(_block_sql("{docs}", "regexp_like"), docs=documents.lines(table(spark, sf_dir, "documents")).withColumnRenamed("line", "text"))


_OF_LINES = {
    "contains_clause_punctuation": "{like}(text, '[,;]')", "has_terminal_period": "{like}(text, '[.]$')", "ends_with_colon": "{like}(text, ':$')", "looks_like_bullet": "{like}(text, '^[-*•]')",
    "contains_url_or_email": "{like}(text, 'https?://|@')", "contains_email": "{like}(text, '@')", "top_zone_candidate": "line_no < 2", "bottom_zone_candidate": "line_no % 9 = 8",
    "word_count": "(length(text) - length(replace(text, ' ', '')) + 1) * 1e0", "page_block_count": "(count(*) OVER (PARTITION BY doc_id)) * 1e0", "line_count": "1e0 + line_no % 2",
    "relative_font_size": "9e-1 + (line_no % 4) / 10e0",
}


def _block_sql(source: str, like: str) -> str:
    n = "(doc_id * 31 + line_no * 7)"
    deal = lambda i, k: f"({n} * {17 + 2 * i} + {n} // 3 * {i + 1}) % {k}"
    columns = {k: v.format(like=like) for k, v in _OF_LINES.items()}
    for i, c in enumerate(x for x in gate_oracle.BOOLEANS if x not in _OF_LINES):
        columns[c] = f"CASE WHEN ({n} + {i}) % 19 <> 0 THEN {deal(i, 29)} < 2 END"
    for i, c in enumerate(gate_oracle.FLAG_CELLS):
        columns[c] = f"CASE {deal(i + 60, 13)} WHEN 0 THEN '1' WHEN 1 THEN '0.6' WHEN 2 THEN '' WHEN 3 THEN '0.4' WHEN 4 THEN '0' END"
    for i, c in enumerate(x for x in gate_oracle.NUMBERS if x not in _OF_LINES):
        columns[c] = f"CASE WHEN ({n} + {i}) % 17 <> 0 THEN {deal(i + 80, 101)} / 100e0 END" if c.startswith("model_") else f"CASE WHEN ({n} + {i}) % 17 <> 0 THEN ({n} * {13 + 2 * i}) % 21 / 20e0 END"
    columns["digit_ratio"] = f"CASE {deal(7, 4)} WHEN 0 THEN '0.75' WHEN 1 THEN '' WHEN 2 THEN '0.2' END"
    for i, c in enumerate(gate_oracle.DISTANCES):
        columns[c] = f"CASE WHEN ({n} + {i}) % 3 = 0 THEN ({n} * {3 + i}) % 12 * 1e0 END"
    columns["near_dest_annotation_distance"] = f"CASE {deal(3, 6)} WHEN 0 THEN '1' WHEN 1 THEN '2.0' WHEN 2 THEN '7.5' WHEN 3 THEN '' END"
    text = f"CASE {n} % 23 WHEN 0 THEN NULL WHEN 1 THEN chr(10) || '2.1' || chr(9) || text WHEN 2 THEN ' • ' WHEN 3 THEN ' 3. ' || lower(text) WHEN 4 THEN 'Open ' || substr(text, 1, 9) ELSE text END"
    sql = f"SELECT doc_id, line_no, {text} AS text, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {source}"
    return sql if like == "regexp_matches" else sql.replace("//", "DIV").replace("https?:DIV", "https?://")


_STRATEGIES = ("rule", "model", "weighted", "naive", "gated")
_GATE_LABELS = [*[f"{s}_label" for s in _STRATEGIES], "model_second", "weighted_second", "blocked_reason"]
_GATE_SCORES = [*[f"{k}_{x}" for k in ("rule", "context", "weighted") for x in gate_oracle.LABELS], "weighted_best", "weighted_margin", "model_confidence", "model_margin"]
_BLOCKS = f"({_block_sql(f'(SELECT doc_id, line_no, line AS text FROM ({_LINES}))', 'regexp_matches')})"


def _gated(preset: str) -> str:
    return f"SELECT doc_id, line_no::BIGINT AS line_no, {', '.join(_GATE_LABELS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _GATE_SCORES)} FROM ({gate_oracle.gate_sql(_BLOCKS, preset)})"


def _predicted(spark: SparkSession, sf_dir: str, preset: str = "conservative") -> DataFrame:
    return block_rules.predicted(_blocks(spark, sf_dir), preset)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("line_no").cast("long").alias("line_no"), *_GATE_LABELS, *[F.round(c, 6).alias(c) for c in _GATE_SCORES])


@query(_gated("conservative"))
def block_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_predicted(spark, sf_dir))


@query(_gated("tuned"))
def block_gate_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_predicted(spark, sf_dir, "tuned"))


@query(f"SELECT rule_label, model_label, count(*) AS n FROM ({gate_oracle.gate_sql(_BLOCKS)}) GROUP BY ALL")
def conflict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.conflicts(_predicted(spark, sf_dir), "rule_label", "model_label")


_LONG = f"SELECT doc_id % 20 AS sample, gated_label AS gold, s AS strategy, CASE s {' '.join(f"WHEN '{s}' THEN {s}_label" for s in _STRATEGIES[:4])} END AS pred FROM ({gate_oracle.gate_sql(_BLOCKS)}), (SELECT unnest({list(_STRATEGIES[:4])}) AS s)"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir).withColumn("sample", F.col("doc_id") % 20)
    return metrics.strategies_long(rows, ["sample"], _STRATEGIES[:4], "gated_label")


@query(f"""
WITH l AS ({_LONG}), a AS (SELECT strategy, sample, round_even(count(*) FILTER (gold = pred)::DOUBLE / count(*), 4) AS accuracy FROM l GROUP BY ALL),
d AS (SELECT a.strategy, round_even(a.accuracy - coalesce(b.accuracy, 0), 4) AS d FROM a LEFT JOIN a b ON a.sample = b.sample AND b.strategy = 'rule' WHERE a.strategy <> 'rule')
SELECT strategy, count(*) FILTER (d > 0) AS n_improved, count(*) FILTER (d < 0) AS n_regressed, round_even(avg(d), 4) AS mean_delta FROM d GROUP BY strategy
""")
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.against_baseline(metrics.accuracy_by(_long(spark, sf_dir), "sample", by=["strategy"]), "rule", "sample")


_PRF = """SELECT {by}label, sum(CASE WHEN g THEN n ELSE 0 END)::BIGINT AS support, sum(CASE WHEN g AND gold = pred THEN n ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN NOT g AND gold <> pred THEN n ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN g AND gold <> pred THEN n ELSE 0 END)::BIGINT AS fn
  FROM (SELECT *, gold AS label, TRUE AS g FROM c UNION ALL SELECT *, pred, FALSE FROM c) GROUP BY ALL"""


@query(f"""
WITH l AS ({_LONG}), c AS (SELECT strategy, gold, pred, count(*) AS n FROM l GROUP BY ALL), s AS ({_PRF.format(by='strategy, ')}),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM s)
SELECT strategy, label, support, tp, fp, fn, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM p
""")
def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_label(metrics.confusion(_long(spark, sf_dir), by=["strategy"]), ["strategy"])


_TARGETED = """count(*) FILTER (pred = 'heading' AND gold <> 'heading') AS heading_false_positive_count, count(*) FILTER (gold = 'separator' AND pred = 'list_item') AS separator_as_list_count,
  count(*) FILTER (pred IN ('table_like', 'form_row') AND gold NOT IN ('table_like', 'form_row')) AS false_table_promotion_count,
  count(*) FILTER (pred = 'footer_header_noise' AND gold NOT IN ('footer_header_noise', 'separator')) AS false_noise_drop_count,
  count(*) FILTER (gold = 'footer_header_noise' AND pred <> 'footer_header_noise') AS footer_header_false_negative_count, count(*) FILTER (pred = 'link_text' AND gold <> 'link_text') AS link_text_false_positive_count,
  count(*) FILTER (gold = 'link_text' AND pred <> 'link_text') AS link_text_false_negative_count"""


@query(f"""
WITH l AS ({_LONG}) SELECT strategy, {_TARGETED} FROM l GROUP BY strategy
""")
def targeted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.targeted(metrics.confusion(_long(spark, sf_dir), by=["strategy"]), ["strategy"])


# From manifest, features and labels to reports

#: What the made-up blocks are labelled: current, older and unknown names, in turn by row.
_RAW = ("BodyText", "Heading", "table_like", "form_row", "list_item", "Caption", "Noise", "separator", "link_text", "Unknown", "CrossPageMerge", "")
_MODELLED = [*[c for c in gate_oracle.NUMBERS if not c.startswith("model_")], "digit_ratio", *gate_oracle.BOOLEANS, *gate_oracle.FLAG_CELLS, *gate_oracle.DISTANCES, *gate_oracle.DISTANCE_CELLS]


def _lab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A manifest of forty samples, their features and labels, made of documents' lines."""
    blocks = _blocks(spark, sf_dir).drop(*[c for c in gate_oracle.NUMBERS if c.startswith("model_")])
    none = F.lit(None).cast("string")
    key = dict(zip(ROW_KEY, (F.lit("block"), F.col("doc_id"), F.col("line_no"), F.lit("0"), none, none, none)))
    rows = blocks.withColumn("sample_id", F.concat(F.lit("s"), F.col("doc_id") % 40)).withColumns(key)
    n = F.col("doc_id") * 3 + F.col("line_no")
    named = F.get(F.array(*map(F.lit, _RAW)), (F.col("line_no") * 7 + F.col("doc_id")) % len(_RAW))
    raw = F.when(F.col("looks_like_separator"), "separator").when(F.col("is_heading_kind"), "Heading").otherwise(named)
    labels = rows.where(n % 4 != 0).select("sample_id", *ROW_KEY, raw.alias("raw_label"), F.lit(0).alias("seq"))
    manifest = spark.range(40).select(
        F.concat(F.lit("s"), "id").alias("sample_id"), F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "heldout").otherwise("other").alias("split"), F.when(F.col("id") % 8 == 7, "boundary").otherwise("block").alias("record_kind"),
        F.when(F.col("id") % 10 == 9, "none").otherwise("manual").alias("label_source"), F.lit("labels.tsv").alias("label_path"),
    )
    return manifest, rows.drop("doc_id", "line_no"), labels


def _lab_sql() -> str:
    """CTEs up to ``p``: predictions of labelled block rows with their split, gold label and sample."""
    legacy = "CASE raw WHEN 'BodyText' THEN 'paragraph' WHEN 'Heading' THEN 'heading' WHEN 'Noise' THEN 'footer_header_noise' WHEN 'Caption' THEN 'caption' WHEN 'Unknown' THEN 'keep_as_text' WHEN 'CrossPageMerge' THEN NULL WHEN '' THEN NULL ELSE raw END"
    named = "CASE (line_no * 7 + doc_id) % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_RAW)) + " END"
    number = lambda c: f"coalesce(nullif({c}, '')::DOUBLE, 0)" if c in (*gate_oracle.FLAG_CELLS, *gate_oracle.NUMBER_CELLS, *gate_oracle.DISTANCE_CELLS) else f"coalesce({c}::INT::DOUBLE, 0)" if c in gate_oracle.BOOLEANS else f"coalesce({c}, 0)::DOUBLE"
    inputs = _MODELLED
    labels = "paragraph heading table_like form_row list_item caption footer_header_noise separator link_text keep_as_text".split()
    return f"""
    b AS (SELECT * EXCLUDE ({', '.join(c for c in gate_oracle.NUMBERS if c.startswith('model_'))}), doc_id % 40 AS sample, CASE doc_id % 40 % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'heldout' ELSE 'other' END AS split,
      CASE WHEN looks_like_separator THEN 'separator' WHEN is_heading_kind THEN 'Heading' ELSE {named} END AS raw FROM {_BLOCKS}),
    r AS MATERIALIZED (SELECT *, {legacy} AS gold, [{', '.join(map(number, inputs))}] AS x FROM b WHERE (doc_id * 3 + line_no) % 4 <> 0 AND sample % 10 <> 9 AND sample % 8 <> 7 AND {legacy} IS NOT NULL),
    v AS (SELECT doc_id, line_no, gold, unnest(range(1, {len(inputs)} + 1)) AS i, unnest(x) AS x FROM r WHERE split = 'train'),
    s AS (SELECT i, avg(x) AS mean, CASE WHEN var_pop(x) > 1e-12 THEN sqrt(var_pop(x)) ELSE 1 END AS scale FROM v GROUP BY i),
    z AS (SELECT gold, i, (x - mean) / scale AS z FROM v JOIN s USING (i)), o AS (SELECT gold, i, sum(z) AS sum, count(*) AS n FROM z GROUP BY ALL),
    c AS (SELECT gold, i, sum / n AS pos, coalesce((sum(sum) OVER (PARTITION BY i) - sum) / nullif(sum(n) OVER (PARTITION BY i) - n, 0), 0) AS neg FROM o),
    w AS (SELECT gold AS label, list(pos - neg ORDER BY i) AS w, -sum((pos - neg) * (pos + neg) / 2) AS bias FROM c GROUP BY gold),
    t AS (SELECT list(mean ORDER BY i) AS mean, list(scale ORDER BY i) AS scale FROM s),
    m AS (SELECT doc_id, line_no, label, bias + list_sum(list_transform(list_zip(x, mean, scale, w), lambda k: (k[1] - k[2]) / k[3] * k[4])) AS raw FROM r, t, w),
    k AS MATERIALIZED (SELECT doc_id, line_no, {', '.join(f"coalesce(max(1 / (1 + exp(-raw))) FILTER (label = '{x}'), 0) AS model_{x}" for x in labels)} FROM m GROUP BY ALL),
    p AS MATERIALIZED (SELECT g.*, r.split, r.gold, r.sample FROM ({gate_oracle.gate_sql('(SELECT b.*, ' + ', '.join(f'model_{x}' for x in labels) + ' FROM b JOIN k USING (doc_id, line_no))')}) g JOIN r USING (doc_id, line_no))"""


_REPORT = {"rules_only": "rule", "model_only": "model", "rules_model_naive": "naive", "rules_model_weighted": "weighted", "rules_model_gated": "gated"}
_HELD = f"h AS MATERIALIZED (SELECT sample, gold, strategy, CASE strategy {' '.join(f"WHEN '{s}' THEN {c}_label" for s, c in _REPORT.items())} END AS pred FROM p, (SELECT unnest({list(_REPORT)}) AS strategy) WHERE split = 'heldout')"


@query(f"""
WITH {_lab_sql()}, {_HELD},
a AS (SELECT strategy, sample, round_even(count(*) FILTER (gold = pred)::DOUBLE / count(*), 4) AS accuracy FROM h GROUP BY ALL),
d AS (SELECT a.strategy, count(*) FILTER (a.accuracy > q.accuracy) AS improved_sample_count, count(*) FILTER (a.accuracy < q.accuracy) AS regressed_sample_count FROM a JOIN a q ON a.sample = q.sample AND q.strategy = 'rules_only' GROUP BY a.strategy),
e AS (SELECT strategy, count(*) AS support, count(*) FILTER (gold = pred)::DOUBLE / count(*) AS f, {_TARGETED} FROM h GROUP BY strategy)
SELECT e.* EXCLUDE (f), round_even(f, 4) AS precision, round_even(f, 4) AS recall, round_even(f, 4) AS f1, improved_sample_count, regressed_sample_count FROM e JOIN d USING (strategy)
""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.ablation(*_lab(spark, sf_dir)).summary


@query(f"""
WITH {_lab_sql()} SELECT 's' || sample AS sample_id, doc_id::VARCHAR AS page_index, line_no::VARCHAR AS block_index, split, gold AS gold_label, {', '.join(f'{c}_label' for c in _REPORT.values())}, blocked_reason,
  round(model_confidence, 6) AS model_confidence, round(model_margin, 6) AS model_margin, round(weighted_margin, 6) AS weighted_margin FROM p
""")
def ablation_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [f"{c}_label" for c in _REPORT.values()]
    rows = ablation.ablation(*_lab(spark, sf_dir)).predictions
    return rows.select("sample_id", "page_index", "block_index", "split", "gold_label", *shown, "blocked_reason", *[F.round(c, 6).alias(c) for c in ("model_confidence", "model_margin", "weighted_margin")])


@query("""
WITH n AS (SELECT doc_id % 40 AS s, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents) GROUP BY ALL), m AS (SELECT unnest(range(0, 40)) AS s)
SELECT 's' || s AS sample_id, CASE s % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'heldout' ELSE 'other' END AS split, CASE WHEN s % 8 = 7 THEN 'boundary' ELSE 'block' END AS record_kind, coalesce(n, 0) AS candidate_count
FROM m LEFT JOIN n USING (s) WHERE s % 10 = 9
""")
def ablation_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, features, labels = _lab(spark, sf_dir)
    return ablation.labelled_rows(manifest, features, labels)[1]


# Evaluation over documents and labels

_PRED = "SELECT d.doc_id, d.source, d.lang, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold, CASE WHEN length(text) - length(replace(text, '.', '')) < 2 OR n_chars < 80 THEN 'bad' WHEN n_chars > 20000 THEN 'long' ELSE 'good' END AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    pred = F.when((T.occurrences(F.col("text"), F.lit(".")) < 2) | (F.col("n_chars") < 80), "bad").when(F.col("n_chars") > 20000, "long").otherwise("good")
    return docs.select("doc_id", "source", "lang", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"), pred.alias("pred"))


@query(f"SELECT gold, pred, count(*) AS n FROM ({_PRED}) GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_judged(spark, sf_dir))


@query(f"""
WITH c AS (SELECT gold, pred, count(*) AS n FROM ({_PRED}) GROUP BY ALL), s AS ({_PRF.format(by='')}),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM s)
SELECT label, support, tp, fp, fn, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1,
  support > 0 AND tp = 0 AS zero_recall, support > 0 AND support < 5 AS low_support FROM p
""")
def per_label_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_support_flags(metrics.per_label(metrics.confusion(_judged(spark, sf_dir))))


@query(f"""
WITH l AS ({_PRED}), s AS (SELECT lang, count(*) FILTER (gold = pred) AS tp, count(*) FILTER (gold <> pred) AS fp, count(*) FILTER (gold <> pred) AS fn FROM l GROUP BY lang)
SELECT lang, tp, fp, fn, round_even(tp::DOUBLE / (tp + fp), 4) AS precision, round_even(tp::DOUBLE / (tp + fn), 4) AS recall, round_even(tp::DOUBLE / (tp + fp), 4) AS f1 FROM s
""")
def micro_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro(metrics.confusion(_judged(spark, sf_dir), by=["lang"]), ["lang"])


@query(f"""
WITH l AS ({_PRED}), t AS (SELECT unnest(['good', 'bad', 'unused']) AS label),
s AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM t, l GROUP BY label),
f AS (SELECT round_even(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) END, 4) AS f1 FROM s)
SELECT (SELECT round_even(avg(f1), 4) FROM f) AS macro_f1, (SELECT round_even(count(*) FILTER (gold = pred)::DOUBLE / count(*), 4) FROM l) AS accuracy
""")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(metrics.confusion(_judged(spark, sf_dir)), ["good", "bad", "unused"])


@query(f"SELECT source, count(*) AS n, count(*) FILTER (gold = pred) AS n_right, round_even(count(*) FILTER (gold = pred)::DOUBLE / count(*), 4) AS accuracy FROM ({_PRED}) GROUP BY source")
def per_sample_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_by(_judged(spark, sf_dir), "source")


@query(f"WITH c AS (SELECT lang, gold, pred, count(*) AS n FROM ({_PRED}) WHERE gold <> pred GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gold, pred) AS rank FROM c QUALIFY rank <= 10")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_confusions(metrics.confusion(_judged(spark, sf_dir), by=["lang"]), 10, ["lang"])


@query(f"SELECT doc_id, lang, gold, pred, row_number() OVER (PARTITION BY lang, gold, pred ORDER BY doc_id) AS rank FROM ({_PRED}) WHERE gold <> pred QUALIFY rank <= 3")
def confusion_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.examples(_judged(spark, sf_dir).drop("source"), ["doc_id"], 3, ["lang"])


@query("SELECT source, string_agg(k || ':' || n, ';' ORDER BY k) AS langs, sum(n)::BIGINT AS n FROM (SELECT source, lang AS k, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def packed_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    packed = F.array_join(F.array_sort(F.collect_list(F.concat("lang", F.lit(":"), "n"))), ";")
    return n.groupBy("source").agg(packed.alias("langs"), F.sum("n").alias("n"))


@query("SELECT lang, quality, count(*) AS n, grouping(quality)::BIGINT AS is_total FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (lang), ())")
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.rollup("lang", "quality").agg(F.count("*").alias("n"), F.grouping("quality").cast("long").alias("is_total"))


# Linear models over embeddings


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


_VEC = "WITH v AS (SELECT vec_id, label, i - 1 AS i, coalesce(embedding[i], 0)::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), s AS (SELECT i, avg(x) AS mean, CASE WHEN var_pop(x) > 1e-12 THEN sqrt(var_pop(x)) ELSE 1 END AS scale FROM v GROUP BY i)"
_CENT = _VEC + """, z AS (SELECT vec_id, label, v.i, (x - mean) / scale AS z FROM v JOIN s ON v.i = s.i),
o AS (SELECT label, i, sum(z) AS s, count(*) AS n FROM z GROUP BY ALL),
p AS (SELECT label, i, s / n AS pos, (sum(s) OVER (PARTITION BY i) - s) / nullif(sum(n) OVER (PARTITION BY i) - n, 0) AS neg FROM o),
w AS (SELECT label, i, pos - neg AS weight, -sum((pos + neg) / 2 * (pos - neg)) OVER (PARTITION BY label) AS bias FROM p),
c AS (SELECT vec_id, z.label, w.label AS candidate, first(bias) + sum(z * weight) AS score FROM z JOIN w ON z.i = w.i GROUP BY ALL)"""


@query(_VEC + " SELECT i::BIGINT AS i, round(mean, 6) AS mean, round(scale, 6) AS scale FROM s")
def normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.normalisation(_vectors(spark, sf_dir)).select(F.col("i").cast("long").alias("i"), F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query(_CENT + " SELECT label::BIGINT AS label, i::BIGINT AS i, round(weight, 6) AS weight, round(bias, 6) AS bias FROM w")
def centroid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _vectors(spark, sf_dir)
    rows = models.centroid_weights(long, models.normalisation(long))
    return rows.select(F.col("label").cast("long").alias("label"), F.col("i").cast("long").alias("i"), F.round("weight", 6).alias("weight"), F.round("bias", 6).alias("bias"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _vectors(spark, sf_dir)
    scales = models.normalisation(long)
    model = models.linear_model(scales, models.centroid_weights(long, scales))
    return models.scores(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), model, "embedding").drop("embedding")


@query(_CENT + " SELECT vec_id, label::BIGINT AS label, (arg_max(candidate, (round_even(score, 9), -candidate)))::BIGINT AS pred, round(max(score), 6) AS score FROM c GROUP BY vec_id, label")
def centroid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.best(_scored(spark, sf_dir))
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.col("pred").cast("long").alias("pred"), F.round("score", 6).alias("score"))


@query(_CENT + " SELECT candidate::BIGINT AS candidate, round((min(score) FILTER (label = candidate) + coalesce(max(score) FILTER (label <> candidate), 0)) / 2, 6) AS threshold FROM c GROUP BY candidate")
def centroid_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.thresholds(_scored(spark, sf_dir)).select(F.col("candidate").cast("long").alias("candidate"), F.round("threshold", 6).alias("threshold"))


@query(_CENT + """, t AS (SELECT candidate, (min(score) FILTER (label = candidate) + coalesce(max(score) FILTER (label <> candidate), 0)) / 2 AS least FROM c GROUP BY candidate),
e AS (SELECT vec_id, candidate, score, 1 / (1 + exp(-score)) AS confidence, least, score >= least AND 1 / (1 + exp(-score)) >= 0.5 AS accepted FROM c JOIN t USING (candidate))
SELECT vec_id, candidate::VARCHAR AS pred, round(score, 6) AS score, round(confidence, 6) AS confidence, round(least, 6) AS threshold, accepted FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY accepted DESC, score DESC, candidate::VARCHAR) = 1""")
def accepted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _vectors(spark, sf_dir)
    scales = models.normalisation(long)
    model = models.linear_model(scales, models.centroid_weights(long, scales).withColumn("label", F.col("label").cast("string")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    least = {r["candidate"]: (r["threshold"], 0.5) for r in models.thresholds(models.scores(rows, model, "embedding")).collect()}  # one row a label
    model = models.LinearModel.of_json(replace(model, least=least).to_json())
    out = models.classified(rows, model, F.col("embedding"))
    return out.select("vec_id", "pred", *[F.round(c, 6).alias(c) for c in ("score", "confidence", "threshold")], "accepted")


@query()
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("values"))
    return models.fit_logistic(rows)[1](rows).select("vec_id", "label", "pred", "confidence")


# Joins, differences, versions


@query("""
WITH f AS (SELECT o_orderstatus AS sample_id, l_returnflag AS record_kind, l_orderkey AS a, l_linenumber AS b, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
l AS (SELECT sample_id, record_kind, a, b, arg_max(l_partkey % 10, l_partkey) AS label FROM f WHERE l_partkey % 2 = 0 GROUP BY ALL)
SELECT f.sample_id, a::VARCHAR AS page_index, b::VARCHAR AS block_index, label::BIGINT AS label, count(*) AS n FROM f JOIN l USING (sample_id, record_kind, a, b) GROUP BY ALL
""")
def feature_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(None).cast("string")
    key = dict(zip(ROW_KEY, (F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_linenumber"), F.lit(""), none, none, none)))
    f = rows.select(F.col("o_orderstatus").alias("sample_id"), *[v.alias(k) for k, v in key.items()], "l_partkey")
    labels = f.where("l_partkey % 2 = 0").withColumn("label", F.col("l_partkey") % 10).withColumnRenamed("l_partkey", "seq")
    return relations.join_labels(f, labels).groupBy("sample_id", "page_index", "block_index", "label").agg(F.count("*").alias("n"))


@query("""
WITH m(source_label, target_label, use_for_training) AS (VALUES ('Brand#11', 'paragraph', 'yes'), ('Brand#12', ' Ignore ', 'no'), ('Brand#13', 'Uncertain', ' NO '), ('Brand#14', 'uncertain', NULL), ('Brand#15', NULL, 'no'),
  ('Brand#21', 'heading', 'yes'), ('Brand#22', 'unknown', 'yes'), ('Brand#23', 'IGNORED', NULL))
SELECT coalesce(target_label, CASE WHEN source_label IS NULL THEN 'unmapped' ELSE 'none' END) AS target_label, count(*) AS n FROM part LEFT JOIN m ON p_brand = source_label
WHERE source_label IS NULL OR source_label NOT IN ('Brand#12', 'Brand#13', 'Brand#23') GROUP BY ALL
""")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Brand#11", "paragraph", "yes"), ("Brand#12", " Ignore ", "no"), ("Brand#13", "Uncertain", " NO "), ("Brand#14", "uncertain", None), ("Brand#15", None, "no"), ("Brand#21", "heading", "yes"),
            ("Brand#22", "unknown", "yes"), ("Brand#23", "IGNORED", None)]
    mapping = spark.createDataFrame(rows, "source_label string, target_label string, use_for_training string")
    done, rejected = layout.mapped(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "source_label"), mapping)
    both = done.select(F.coalesce("target_label", F.lit("none")).alias("target_label")).unionByName(rejected.select(F.lit("unmapped").alias("target_label")))
    return both.groupBy("target_label").agg(F.count("*").alias("n"))


_AREA = "greatest(0, least(r.x + r.w, c.x + c.w) - greatest(r.x, c.x)) * greatest(0, least(r.y + r.h, c.y + c.h) - greatest(r.y, c.y)) / (c.w * c.h)"


@query(f"""
WITH r AS ({_REGIONS}), c AS (SELECT page_id, seq, x + 20 AS x, y + 4 AS y, w, h, text FROM r WHERE seq % 2 = 1 AND page_id % 5 > 1),
t AS (SELECT r.page_id, r.seq AS region_id, string_agg(c.text, ' ' ORDER BY c.y, c.x, c.text) AS text FROM r JOIN c ON r.page_id = c.page_id AND {_AREA} >= 0.2::DOUBLE GROUP BY ALL)
SELECT r.page_id, r.seq AS region_id, coalesce(t.text, '') AS text, CASE WHEN t.text IS NOT NULL THEN 'text_cells_overlap_v1' WHEN r.page_id % 3 = 0 AND r.page_id % 5 > 0 AND r.page_id NOT IN (SELECT page_id FROM c) THEN 'missing_text_cells'
  WHEN r.page_id % 5 = 0 THEN 'invalid_text_cells_json' WHEN r.page_id NOT IN (SELECT page_id FROM c) THEN 'text_cells_unparsed' ELSE 'text_cells_no_overlap_todo_bbox_alignment' END AS text_status
FROM r LEFT JOIN t ON r.page_id = t.page_id AND r.seq = t.region_id
""")
def spatial_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _regions(spark, sf_dir)
    cells = r.where("seq % 2 = 1 and page_id % 5 > 1").select("page_id", (F.col("x") + 20).alias("x"), (F.col("y") + 4).alias("y"), "w", "h", "text")
    pages = r.groupBy("page_id").agg(F.max((F.col("seq") % 2 == 1) & (F.col("page_id") % 5 > 1)).alias("has_cells"))
    payloads = pages.where("page_id % 5 = 0 or page_id % 3 <> 0 or has_cells").select("page_id", F.when(F.col("page_id") % 5 == 0, "{").otherwise("{}").alias("payload"))
    return layout.text_of_regions(r.withColumnRenamed("seq", "region_id"), cells, payloads=payloads)


_OLD_NEW = """o AS (SELECT o_orderkey AS k, o_orderstatus AS g, o_orderpriority AS v FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT o_orderkey AS k, o_orderstatus AS g, CASE WHEN o_orderkey % 5 = 0 THEN 'moved' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT coalesce(o.k, n.k) AS k, coalesce(o.g, n.g) AS g, o.v AS old_value, n.v AS new_value,
  CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.k = n.k AND o.g = n.g)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("v"))
    new = rows.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "moved").otherwise(F.col("v")))
    return relations.keyed_diff(rows.where("k % 7 <> 0"), new, ["k", "g"], "v")


@query(f"WITH {_OLD_NEW} SELECT * FROM d")
def key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(f"""
WITH {_OLD_NEW}, c AS (SELECT g, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'unchanged') AS n_unchanged FROM d GROUP BY g)
SELECT *, CASE WHEN n_added + n_removed + n_changed = 0 THEN 'Pub==' ELSE 'Pub-A' || n_added || '-R' || n_removed || '-C' || n_changed END AS code FROM c
""")
def encoded_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.diff_summary(_diff(spark, sf_dir), ["g"], "Pub")


@query("""
WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey % 50) FILTER (l_linenumber <= 3) AS o, list(DISTINCT l_partkey % 50) FILTER (l_linenumber >= 2) AS n FROM lineitem GROUP BY 1)
SELECT k, array_to_string(list_sort(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(o, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(n, []), x))), ',') AS removed,
  array_to_string(list_sort(list_filter(coalesce(o, []), lambda x: list_contains(coalesce(n, []), x))), ',') AS common FROM a
""")
def set_diff_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set(F.when(F.col("l_linenumber") <= 3, part)).alias("o"), F.collect_set(F.when(F.col("l_linenumber") >= 2, part)).alias("n")
    )
    d = relations.set_diff(F.col("o"), F.col("n"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",").alias
    return rows.withColumn("d", d).select("k", *[joined(F.col(f"d.{c}"))(c) for c in ("added", "removed", "common")])


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS version FROM events QUALIFY version <= 2")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.versions(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])
    return rows.where("version <= 2").drop("ts")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    return relations.last_wins(rows, ["user_id"], "at").select("user_id", "event_type", "event_id")


@query("""
WITH b AS (SELECT user_id, event_id, event_type, coalesce(lag(event_type) OVER w <> event_type, TRUE) AS is_break, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, is_break, sum(is_break::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM b
""")
def category_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.breaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "is_break", "island")


@query("SELECT n_name AS name, min(c_name) AS old_name, count(c_name) AS n_matches, CASE WHEN count(c_name) = 0 THEN 'older_not_found' WHEN count(c_name) > 1 THEN 'several_older' ELSE 'matched' END AS status FROM (SELECT 'Customer#' || lpad(n_nationkey::VARCHAR, 4, '0') || n_name AS n_name FROM nation) LEFT JOIN customer ON substr(c_name, 1, 13) = substr(n_name, 1, 13) GROUP BY n_name")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "nation").select(F.concat(F.lit("Customer#"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), "n_name").alias("name"))
    return relations.prefix_match(new, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 7 = 0)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return relations.orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), parents, "c_custkey")


@query("SELECT md5(text) AS digest, sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text")
def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("digest", "sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


# Manifests


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.when(d % 10 == 0, "  ").otherwise(F.concat(F.lit(" s"), d)).alias("sample_id"), F.when(d % 3 == 0, "train").when(d % 3 == 1, "heldout").otherwise("other").alias("split"),
        F.when(d % 4 == 0, "none").when(d % 4 == 1, "manual").otherwise("tool").alias("label_source"), F.when(d % 6 == 0, "").otherwise(F.concat(F.lit("labels/"), d, F.lit(".tsv"))).alias("label_path"),
        F.concat(F.lit("in/"), d, F.lit("."), F.when(d % 5 == 0, "PDF").when(d % 5 == 1, "gif").otherwise("png")).alias("relative_path"), F.when(d % 7 == 0, "true").otherwise("false").alias("local_only"),
    )


@query("""
SELECT 's' || doc_id AS sample_id, CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'heldout' END AS split,
  CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 0 THEN 'controls' WHEN doc_id % 4 = 1 THEN 'manual' ELSE 'labelled' END AS route
FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 3 < 2
""")
def manifest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.with_route(manifests.selected(_manifest(spark, sf_dir), ["train", "heldout"])).select("sample_id", "split", "route")


@query("""
SELECT 'in/' || doc_id || '.' || e AS relative_path, lower(e) AS suffix, CASE WHEN e = 'gif' THEN 'skipped' ELSE 'ready' END AS status, CASE WHEN e = 'gif' THEN 'suffix_gif' ELSE '' END AS reason
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'gif' ELSE 'png' END AS e FROM documents WHERE doc_id % 7 <> 0) JOIN (SELECT DISTINCT page_id FROM pages) ON doc_id = page_id
""")
def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _manifest(spark, sf_dir)
    there = table(spark, sf_dir, "pages").select(F.explode(F.array(*[F.concat(F.lit("in/"), "page_id", F.lit(e)) for e in (".PDF", ".gif", ".png")])).alias("relative_path"))
    return manifests.with_suffix_status(manifests.payloads(entries, there), ["pdf", "png"]).select("relative_path", "suffix", "status", "reason")


@query("""
WITH m(source_label, target_label, use_for_training) AS (VALUES ('MAIL', 'paragraph', 'yes'), ('SHIP', 'heading', NULL), ('AIR', 'caption', 'no'), ('RAIL', ' ', 'yes'), ('FOB', 'paragraph', 'yes'), ('TRUCK', 'table', 'yes'),
  ('R', 'heading', 'yes'), ('A', 'caption', NULL), ('N', 'paragraph', 'no'))
SELECT l_orderkey AS image_id, string_agg(DISTINCT target_label, ';' ORDER BY target_label) AS labels FROM lineitem JOIN m ON l_returnflag = source_label
WHERE coalesce(use_for_training, '') <> 'no' AND trim(target_label) <> '' GROUP BY l_orderkey
""")
def eligible_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("MAIL", "paragraph", "yes"), ("SHIP", "heading", None), ("AIR", "caption", "no"), ("RAIL", " ", "yes"), ("FOB", "paragraph", "yes"), ("TRUCK", "table", "yes"), ("R", "heading", "yes"), ("A", "caption", None), ("N", "paragraph", "no")]
    mapping = spark.createDataFrame(rows, "source_label string, target_label string, use_for_training string")
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("source_label"))
    return manifests.eligible_labels(notes, mapping).withColumn("labels", F.array_join("labels", ";"))


_NUMBER_TEXT = "CASE WHEN {0} = floor({0}) THEN floor({0})::BIGINT::VARCHAR ELSE regexp_replace(printf('%.6f', {0}), '\\.?0+$', '') END"


@query(f"SELECT p_partkey, {' || chr(44) || '.join(_NUMBER_TEXT.format(x) for x in ('x', 'y', 'w', 'h'))} AS bbox FROM (SELECT p_partkey, p_size::DOUBLE AS x, p_size / 8e0 AS y, p_size * 10 / 4e0 AS w, -p_partkey / 16e0 AS h FROM part)")
def box_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", T.bbox_text(size.cast("double"), size / 8.0, size * 10 / 4.0, -F.col("p_partkey") / 16.0).alias("bbox"))


# Scalar functions


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS property FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.explode(F.json_object_keys("props")).alias("property")
    return table(spark, sf_dir, "events").select("event_id", "props", keys).select("event_id", F.try_variant_get(F.parse_json("props"), F.concat(F.lit("$."), "property"), "string").alias("value"), "property")


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '([^/?#]*)(\?.*)?(#.*)?$', 1) AS base,
  regexp_extract(url, '\.([a-z]+)([?#].*)?$', 1) AS suffix FROM pages
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    part = lambda p: F.regexp_extract(u, p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]*)").alias("host"), part(r"([^/?#]*)(\?.*)?(#.*)?$").alias("base"), part(r"\.([a-z]+)([?#].*)?$").alias("suffix"))


_T140 = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({_T140}) <= 140 THEN {_T140} ELSE substr({_T140}, 1, 137) || '...' END AS short FROM documents")
def shortened_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text")).alias("short"))


@query("""
SELECT p_partkey, greatest(round_even(p_size * 0.7::DOUBLE, 0), 1)::BIGINT AS train, greatest(round_even(p_size * 0.15::DOUBLE, 0), 1)::BIGINT AS validation, greatest(round_even(p_size * 0.15::DOUBLE, 0), 1)::BIGINT AS test,
  CASE WHEN p_size >= 25 THEN 1 / (1 + exp(-(p_size - 25) / 10e0)) ELSE exp((p_size - 25) / 10e0) / (1 + exp((p_size - 25) / 10e0)) END AS sigmoid FROM part
""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = T.split_plan(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", *[plan[c].alias(c) for c in ("train", "validation", "test")], T.sigmoid((F.col("p_size") - 25) / 10.0).alias("sigmoid"))


@query("SELECT tag, count(*) AS n, count(DISTINCT lang) AS n_langs FROM (SELECT lang, unnest(list_distinct(list_filter(string_split(source || ';' || lang || ';;' || (n_chars % 3), ';'), lambda t: t <> ''))) AS tag FROM documents) GROUP BY tag")
def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.concat("source", F.lit(";"), "lang", F.lit(";;"), F.col("n_chars") % 3)
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(T.tags_of(packed))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"))


# Documents


@query(r"""
WITH r AS (SELECT DISTINCT 'src' || (item_id % 20) AS source, text AS literal, CASE WHEN item_id % 2 = 0 THEN 'must_include' ELSE 'must_not_include' END AS kind FROM benchmark),
a AS (SELECT r.source, literal, kind, coalesce(sum((length(text) - length(replace(text, literal, ''))) / length(literal)), 0)::BIGINT AS n FROM r LEFT JOIN documents d ON d.source = r.source GROUP BY ALL)
SELECT *, CASE WHEN kind = 'must_include' THEN n > 0 ELSE n = 0 END AS passed FROM a
""")
def assertion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule is about one source: whether a whole benchmark passage stands in any of its documents."""
    kind = F.when(F.col("item_id") % 2 == 0, "must_include").otherwise("must_not_include")
    rules = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), F.col("text").alias("literal"), kind.alias("kind")).distinct()
    return documents.asserted(table(spark, sf_dir, "documents"), rules, "source")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines with bars are written as Markdown rows."""
    rows = documents.lines(table(spark, sf_dir, "documents"))
    line = F.when(F.contains("line", F.lit(" | ")), F.concat(F.lit("| "), "line", F.lit(" |"))).when(F.col("line_no") % 5 == 4, "| --- | --- |").otherwise(F.col("line"))
    return documents.table_lines(rows.withColumn("line", line))


@query(f"""
WITH l AS (SELECT doc_id, line_no, CASE WHEN contains(line, ' | ') THEN '| ' || line || ' |' WHEN line_no % 5 = 4 THEN '| --- | --- |' ELSE line END AS line FROM ({_LINES})),
t AS (SELECT *, length(trim(line)) > 1 AND starts_with(trim(line), '|') AND ends_with(trim(line), '|') AS t FROM l),
s AS (SELECT *, t AND NOT coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY line_no), FALSE) AS s FROM t),
n AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS table_no FROM s),
c AS (SELECT doc_id, table_no, len(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|')) AS k FROM n WHERE t AND NOT regexp_matches(trim(line), '^[|\\- ]+$'))
SELECT doc_id, table_no::BIGINT AS table_no, count(*) AS n_rows, max(k)::BIGINT AS n_cols, CASE WHEN count(*) < 2 THEN 'too_few_rows' WHEN max(k) < 2 THEN 'too_few_columns' WHEN min(k) <> max(k) THEN 'ragged' ELSE 'ok' END AS reason FROM c GROUP BY doc_id, table_no
""")
def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.table_checks(_tables(spark, sf_dir)).withColumn("n_cols", F.col("n_cols").cast("long")).withColumn("table_no", F.col("table_no").cast("long"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs') AS h FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM h
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", documents.html_text(F.col("html")).alias("text"))


@query(r"""
WITH d AS (SELECT doc_id, text, lang, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' ELSE 'PNG' END AS extension FROM documents),
v AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS l, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w, length(regexp_replace(text, '\s', '', 'g')) AS c FROM d)
SELECT doc_id, CASE WHEN lower(extension) <> 'png' THEN 'skipped' WHEN c = 0 THEN 'weak' WHEN c >= 160 OR w >= 30 OR l >= 6 THEN 'pass' ELSE 'weak' END AS status,
  CASE WHEN starts_with(lang, 'es') THEN 'spa' ELSE 'eng' END AS ocr_language, l::BIGINT AS n_lines, w::BIGINT AS n_words, c::BIGINT AS n_nonspace FROM v
""")
def preview_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "pdf").when(F.col("doc_id") % 4 == 1, "txt").otherwise("PNG")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", kind.alias("extension"), F.col("lang").alias("language"), F.lit("").alias("scenario"), F.lit("").alias("tags"))
    return documents.preview_status(docs).select("doc_id", "status", "ocr_language", *[F.col(c).cast("long").alias(c) for c in ("n_lines", "n_words", "n_nonspace")])


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words made of line items."""
    q = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.lit(5).alias("level"), F.lit(1).alias("page_num"), (F.col("l_suppkey") % 2).alias("block_num"), F.lit(1).alias("par_num"), (F.col("l_partkey") % 2).alias("line_num"),
        q.alias("word_num"), (q * 90).alias("left"), F.lit(10).alias("top"), F.lit(50).alias("width"), F.lit(12).alias("height"), F.col("l_quantity").alias("conf"), F.concat("l_returnflag", "l_linestatus").alias("text"),
    )


_WORDS = "SELECT l_orderkey AS image, l_suppkey % 2 AS block_num, l_partkey % 2 AS line_num, l_linenumber AS word_num, l_quantity AS conf, l_returnflag || l_linestatus AS text FROM lineitem"


@query(f"""
WITH w AS ({_WORDS}), l AS (SELECT image, block_num, line_num, string_agg(text, ' ' ORDER BY word_num, text) AS text, avg(conf) AS conf FROM w GROUP BY ALL)
SELECT image, block_num::BIGINT AS block_num, string_agg(text, ' ' ORDER BY line_num) AS text, round(avg(conf), 6) AS conf, count(*) AS n_lines FROM l GROUP BY image, block_num
""")
def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.ocr_blocks(documents.ocr_lines(_words(spark, sf_dir)))
    return rows.select("image", F.col("block_num").cast("long").alias("block_num"), "text", F.round("conf", 6).alias("conf"), "n_lines")


@query(f"""
WITH w AS ({_WORDS}), g AS (SELECT *, coalesce(word_num * 90 - lag(word_num * 90 + 50) OVER (PARTITION BY image, block_num, line_num ORDER BY word_num, text) >= 60, FALSE) AS wide FROM w),
c AS (SELECT *, sum(wide::INT) OVER (PARTITION BY image, block_num, line_num ORDER BY word_num, text ROWS UNBOUNDED PRECEDING) AS column_no FROM g)
SELECT image, column_no::BIGINT AS column_no, block_num::BIGINT AS block_num, line_num::BIGINT AS line_num, string_agg(text, ' ' ORDER BY word_num, text) AS text FROM c GROUP BY ALL
""")
def ocr_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.split_columns(_words(spark, sf_dir)).select("image", *[F.col(c).cast("long").alias(c) for c in ("column_no", "block_num", "line_num")], "text")


# Small operators over made-up rows


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN NULL ELSE 'M' || event_id % 3 END AS ID, event_type FROM events),
b AS (SELECT *, coalesce(trim(ID), '') = '' AS blank FROM e), n AS (SELECT *, CASE WHEN blank THEN 'BlankID_' || sum(blank::INT) OVER (PARTITION BY user_id ORDER BY event_id) ELSE ID END AS name FROM b)
SELECT user_id, name AS ID, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM n GROUP BY user_id, name
""")
def blank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(e % 5 == 0, " ").when(e % 7 == 0, None).otherwise(F.concat(F.lit("M"), e % 3)).alias("ID"), "event_type")
    return relations.first_wins(relations.with_blank_ids(rows, "user_id", "ID", "event_id"), ["user_id", "ID"], "event_id")


@query("""
SELECT p_partkey, CASE WHEN k = 4 THEN NULL ELSE a END AS x, CASE WHEN k = 4 THEN NULL ELSE b END AS y, CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN c - a ELSE c END AS w, CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN d - b ELSE d END AS h
FROM (SELECT p_partkey, p_partkey % 5 AS k, p_size::DOUBLE AS a, p_size / 2e0 AS b, p_size + 10e0 AS c, p_size * 3e0 AS d FROM part)
""")
def boxes_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("double")
    a, b, c, d = n, n / 2, n + 10, n * 3
    named = lambda *names: F.to_json(F.struct(*[v.alias(x) for x, v in zip(names, (a, b, c, d))]))
    text = F.when(k == 0, F.to_json(F.array(a, b, c, d))).when(k == 1, named("x", "y", "w", "h")).when(k == 2, named("left", "top", "width", "height")).when(k == 3, named("x0", "y0", "x1", "y1")).otherwise('{"x":"wide","y":1,"w":2,"h":3}')
    box = T.bbox_of(F.col("t"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", *[box[x].alias(x) for x in "xywh"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'text/plain' END AS mime, c_custkey % 3 = 0 AS is_base64, CASE WHEN c_custkey % 3 = 0 THEN 'utf-8' END AS charset, c_name || ' ä#' || c_custkey AS text,
  CASE WHEN c_custkey % 2 = 0 THEN 'host' || c_custkey END AS file_host, '/dir/' || c_name || '.txt' AS file_path FROM customer
""")
def uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("c_custkey"), F.concat("c_name", F.lit(" ä#"), "c_custkey")
    data = F.when(k % 3 == 0, F.concat(F.lit("data:text/plain;charset=UTF-8;base64,"), F.base64(F.encode(text, "UTF-8")))).when(k % 3 == 1, F.concat(F.lit("data:text/plain,"), F.url_encode(text))).otherwise(F.concat(F.lit("data:,"), F.url_encode(text)))
    file = F.concat(F.lit("file://"), F.when(k % 2 == 0, F.concat(F.lit("host"), k)).otherwise(""), F.lit("/dir/"), F.url_encode("c_name"), F.lit(".txt?x=1#y"))
    found, at = T.data_uri(F.col("d")), T.file_uri(F.col("f"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", data.alias("d"), file.alias("f"))
    return rows.select("c_custkey", found["mime"].alias("mime"), found["is_base64"].alias("is_base64"), found["charset"].alias("charset"), found["text"].alias("text"), at["host"].alias("file_host"), at["path"].alias("file_path"))


_NUMBERED = f"SELECT doc_id, line_no, CASE WHEN (doc_id + line_no) % 5 = 0 THEN ' .' || line_no WHEN (doc_id + line_no) % 7 = 0 THEN ' ' ELSE line END AS line FROM ({_LINES})"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id") + F.col("line_no")
    return documents.lines(table(spark, sf_dir, "documents")).withColumn("line", F.when(at % 5 == 0, F.concat(F.lit(" ."), "line_no")).when(at % 7 == 0, " ").otherwise(F.col("line")))


@query(rf"""
WITH l AS ({_NUMBERED}), s AS (SELECT *, regexp_matches(trim(line), '^\.\d+$') AS part, trim(lead(line) OVER w) AS one, trim(lead(line, 2) OVER w) AS two FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
t AS (SELECT *, CASE WHEN part AND length(one) > 0 THEN 1 WHEN part AND length(two) > 0 THEN 2 END AS step FROM s),
g AS (SELECT *, coalesce(lag(step) OVER w = 1, FALSE) OR coalesce(lag(step, 2) OVER w = 2, FALSE) AS gone FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no::BIGINT AS line_no, CASE step WHEN 1 THEN trim(line) || ' ' || one WHEN 2 THEN trim(line) || ' ' || two ELSE line END AS line FROM g WHERE NOT gone
""")
def merged_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.merge_numbering(_numbered(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(rf"WITH l AS ({_NUMBERED}) SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[ \t]*\.\d+[ \t]*$')) AS n FROM l GROUP BY doc_id")
def isolated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # the lines of one document
    whole = _numbered(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["line"]), "\n").alias("text"))
    return whole.select("doc_id", documents.isolated_numbers(F.col("text")).cast("long").alias("n"))


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(text, '') || repeat(chr(10) || 'more', (doc_id % 4)::INT) || CASE WHEN doc_id % 5 = 0 THEN '|' ELSE '' END AS e FROM documents)
SELECT doc_id, (doc_id % 4)::BIGINT AS line_delta, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS pipe_delta, doc_id % 4 <= 2 AND doc_id % 5 <> 0 AS passed FROM t
""")
def golden_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    more = F.concat("text", F.repeat(F.lit("\nmore"), (F.col("doc_id") % 4).cast("int")), F.when(F.col("doc_id") % 5 == 0, "|").otherwise(""))
    out = documents.golden(docs, docs.select("doc_id", more.alias("text")), "doc_id")
    return out.select("doc_id", F.col("line_delta").cast("long").alias("line_delta"), F.col("pipe_delta").cast("long").alias("pipe_delta"), "passed")


@query("""
WITH e AS (SELECT l_orderkey AS doc, 'x' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT o_orderkey AS doc, 'x' || unnest(range(1, 5)) AS fragment FROM orders)
SELECT k.doc, fragment, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM k LEFT JOIN e ON k.doc = e.doc AND fragment = id
""")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).select("doc", F.concat(F.lit("x"), "k").alias("fragment"))
    elements = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("x"), "l_linenumber").alias("id"))
    return relations.resolve_fragments(links, elements)


@query("""
WITH c AS (SELECT p_partkey AS key, unnest([0, 1, 2]) AS rank FROM part), f AS (SELECT key, rank, 'dir' || rank || '/' || key % 97 AS path FROM c), l AS (SELECT DISTINCT 'dir' || s_suppkey % 3 || '/' || s_suppkey AS path FROM supplier)
SELECT key, arg_min(path, rank) AS path FROM f WHERE path IN (SELECT path FROM l) GROUP BY key
""")
def first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = F.explode(F.array(*map(F.lit, range(3)))).alias("rank")
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), ranks).withColumn("path", F.concat(F.lit("dir"), "rank", F.lit("/"), F.col("key") % 97))
    listing = table(spark, sf_dir, "supplier").select(F.concat(F.lit("dir"), F.col("s_suppkey") % 3, F.lit("/"), "s_suppkey").alias("path"))
    return relations.first_existing(named, listing, "key")


_OCR_TEXT = "CASE l_partkey % 8 WHEN 0 THEN 'Page ' || l_linenumber WHEN 1 THEN '- item ' || l_suppkey WHEN 2 THEN 'Name: value ' || l_suppkey WHEN 3 THEN 'Figure ' || l_linenumber || ' shown' WHEN 4 THEN '12 / 20' WHEN 5 THEN 'A Title' WHEN 6 THEN 'it ends here.' ELSE 'left | right' END"


@query(rf"""
WITH l AS (SELECT l_orderkey AS image, l_suppkey % 3 AS block_num, l_linenumber AS line_num, {_OCR_TEXT} AS text, l_partkey FROM lineitem), k AS (SELECT * FROM l WHERE l_partkey % 8 NOT IN (0, 4)),
b AS (SELECT image, block_num, string_agg(text, ' ' ORDER BY line_num, text) AS text, count(*) AS n FROM k GROUP BY ALL),
t AS (SELECT *, CASE WHEN starts_with(text, '- ') THEN 'ListItem' WHEN starts_with(text, 'Figure ') THEN 'CaptionLike' WHEN regexp_matches(text, '^[^:]{{1,40}}:\s+\S') THEN 'KeyValueLike' WHEN contains(text, ' | ') THEN 'TableLike'
  WHEN n <= 1 AND length(text) <= 60 AND NOT ends_with(text, '.') AND regexp_matches(text, '^[A-Z0-9]') THEN 'Heading' ELSE 'Paragraph' END AS kind FROM b)
SELECT image, string_agg(kind, ',' ORDER BY block_num) AS kinds, string_agg(CASE WHEN kind = 'Heading' THEN '# ' || text ELSE text END, chr(10) || chr(10) ORDER BY block_num) AS markdown FROM t GROUP BY image
""")
def ocr_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), one.alias("page_num"), (F.col("l_suppkey") % 3).alias("block_num"), one.alias("par_num"), F.col("l_linenumber").alias("line_num"), F.expr(_OCR_TEXT).alias("text"), F.lit(90.0).alias("conf")
    )
    blocks = documents.ocr_blocks(rows)
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_num", "kind"))), lambda x: x["kind"]), ",")
    return documents.markdown_preview(blocks).join(blocks.groupBy("image").agg(kinds.alias("kinds")), "image").select("image", "kinds", "markdown")


# Check results, made of orders and their items


def _checks(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """A check a order: lists in a fixed order, with repeated ids, blank message ids, order and content changes, and properties that only one side has."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3" if new else "l_linenumber <> 1")
    s, p, i = (lambda c: F.col(c).cast("string")), F.col("l_partkey"), F.col("l_linenumber")
    only_new = lambda c, a, b: F.when(c, a).otherwise(b) if new else b
    item = F.struct(
        s("l_linenumber").alias("id"), (p % 4 != 0).alias("isSpineItem"), only_new(F.col("l_suppkey") % 3 == 0, i + 10, i + 0).cast("string").alias("spineIndex"),
        only_new(p % 3 == 0, F.concat(F.lit("n"), p), F.concat(F.lit("c"), p)).alias("checkSum"), F.concat(F.lit("f"), i, F.lit(".xhtml")).alias("fileName"),
        only_new(p % 5 == 0, F.lit("image"), F.lit(None).cast("string")).alias("mediaType"), F.transform(F.array(F.col("l_suppkey") % 7, *[p % 3] * new), lambda x: x.cast("string")).alias("referencedItems"),
    )
    place = F.struct(F.when(F.col("l_suppkey") % 11 != 0, s("l_suppkey")).alias("fileName"), F.col("l_linenumber").alias("line"), only_new(p % 7 == 0, F.lit(2), F.lit(1)).alias("column"))
    message = F.struct(
        F.when(i == 3, "").otherwise(F.concat(F.lit("M"), i)).alias("ID"), only_new(p % 5 == 0, F.lit("FATAL"), F.when(i == 2, "ERROR").otherwise("WARNING")).alias("severity"), F.col("l_returnflag").alias("message"),
        (p % 3).alias("additionalLocations"), F.array(place).alias("locations"),
    )
    order = F.struct(i, p, F.col("l_suppkey"), F.col("l_returnflag"), F.col("l_quantity"))
    ordered = lambda part: F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), part.alias("part")))), lambda x: x["part"])
    packed = rows.groupBy(F.col("l_orderkey").alias("file")).agg(ordered(item).alias("items"), ordered(message).alias("messages"), F.count("*").cast("string").alias("n"))
    mine = F.when(F.col("file") % 2 == 0, "en").alias("language") if new else F.when(F.col("file") % 3 == 0, "1").alias("isbn")
    return packed.select("file", F.to_json(F.struct(F.struct(F.col("n").alias("nSpines"), F.lit("t").alias("title"), mine).alias("publication"), "items", "messages")).alias("result"))


def _side(x: str) -> str:
    """CTEs of one side's entries, from the rows themselves."""
    new = x == "b"
    pick = lambda c, a, b: f"CASE WHEN {c} THEN {a} ELSE {b} END" if new else b
    by = "p, s, r, q"
    refs = "[s % 7, p % 3]" if new else "[s % 7]"
    return f"""{x}r AS (SELECT l_orderkey AS f, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, l_returnflag AS r, l_quantity AS q FROM lineitem WHERE {'l_linenumber <= 3' if new else 'l_linenumber <> 1'}),
{x}i AS (SELECT *, i::VARCHAR AS id, ({pick('s % 3 = 0', 'i + 10', 'i')})::VARCHAR AS place, {pick('p % 3 = 0', "'n' || p", "'c' || p")} AS checksum, {pick('p % 5 = 0', "'image'", 'NULL')} AS media, {refs} AS refs
  FROM {x}r QUALIFY row_number() OVER (PARTITION BY f, i ORDER BY p DESC, s DESC, r DESC, q DESC) = 1),
{x}m AS (SELECT *, CASE WHEN i = 3 THEN 'BlankID_' || row_number() OVER (PARTITION BY f, i ORDER BY {by}) ELSE 'M' || i END AS id, {pick('p % 5 = 0', "'FATAL'", "CASE WHEN i = 2 THEN 'ERROR' ELSE 'WARNING' END")} AS severity,
  {pick('p % 7 = 0', '2', '1')} AS col FROM {x}r),
{x}d AS (SELECT *, concat_ws('|', severity, r, p % 3, s, col) AS body FROM {x}m QUALIFY row_number() OVER (PARTITION BY f, id ORDER BY {by}) = 1),
{x} AS (
  SELECT f, 'Pub' AS level, '' AS id, 'nSpines' AS property, count(*)::VARCHAR AS value, count(*)::VARCHAR AS shown FROM {x}r GROUP BY f
  UNION ALL SELECT DISTINCT f, 'Pub', '', 'title', 't', 't' FROM {x}r
  UNION ALL SELECT DISTINCT f, 'Pub', '', {"'language', 'en', 'en'" if new else "'isbn', '1', '1'"} FROM {x}r WHERE f % {2 if new else 3} = 0
  UNION ALL SELECT f, 'Order', id, '', place, place FROM {x}i WHERE p % 4 <> 0
  UNION ALL SELECT f, 'Content', id, '', checksum, 'f' || i || '.xhtml' FROM {x}i WHERE p % 4 <> 0
  UNION ALL SELECT f, 'Mani', id, '', concat_ws('|', p % 4 <> 0, place, checksum, coalesce(media, ''), refs), NULL FROM {x}i
  UNION ALL SELECT f, 'ItemProperty', id, 'isSpineItem', (p % 4 <> 0)::VARCHAR, (p % 4 <> 0)::VARCHAR FROM {x}i
  UNION ALL SELECT f, 'ItemProperty', id, 'spineIndex', place, place FROM {x}i
  UNION ALL SELECT f, 'ItemProperty', id, 'checkSum', checksum, 'f' || i || '.xhtml' FROM {x}i
  UNION ALL SELECT f, 'ItemProperty', id, 'fileName', 'f' || i || '.xhtml', 'f' || i || '.xhtml' FROM {x}i
  UNION ALL SELECT f, 'ItemProperty', id, 'mediaType', media, media FROM {x}i WHERE media IS NOT NULL
  UNION ALL SELECT f, 'Refs', id, unnest(list_distinct(refs))::VARCHAR, '', '' FROM {x}i
  UNION ALL SELECT f, 'Mess', id, '', body, NULL FROM {x}d
  UNION ALL SELECT f, 'MessageProperty', id, k, v, v FROM (SELECT f, id, unnest(['severity', 'message', 'additionalLocations']) AS k, unnest([severity, r, (p % 3)::VARCHAR]) AS v FROM {x}d)
  UNION ALL SELECT f, 'Loc', id, CASE WHEN s % 11 = 0 THEN id || 'HasNullFileNameLoc' ELSE s::VARCHAR END || '-' || i || '-' || col, '', '' FROM {x}d
  UNION ALL SELECT f, 'All', '', 'messages', string_agg(CASE WHEN i = 3 THEN '' ELSE id END || concat_ws('|', severity, r, p % 3, s, col), '/' ORDER BY i, {by}), NULL FROM {x}m GROUP BY f)"""


_DIFFS = f"""{_side('a')}, {_side('b')},
d AS (SELECT coalesce(a.f, b.f) AS file, coalesce(a.level, b.level) AS level, coalesce(a.id, b.id) AS id, coalesce(a.property, b.property) AS property,
  CASE WHEN a.f IS NULL THEN 'added' WHEN b.f IS NULL THEN 'removed' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'unchanged' ELSE 'changed' END AS status, a.shown AS old_value, b.shown AS new_value
  FROM a FULL JOIN b ON a.f = b.f AND a.level = b.level AND a.id = b.id AND a.property = b.property)"""
_mark = lambda letters, c: f"CASE WHEN {c} > 0 THEN '{letters}' || {c} ELSE 'x{letters}' END"
_three = f"concat_ws('-', {_mark('A', 'n_added')}, {_mark('R', 'n_removed')}, {_mark('C', 'n_changed')})"
_COMPARED = f"""{_DIFFS},
c AS (SELECT file, CASE level WHEN 'Order' THEN 'Spine' ELSE level END AS level, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'changed') AS n_changed,
  count(*) FILTER (status = 'unchanged') AS n_unchanged FROM d WHERE level IN ('Pub', 'Order', 'Mani', 'Refs', 'Mess', 'Loc') GROUP BY ALL),
e AS (SELECT file, count(*) FILTER (level = 'Content' AND status = 'changed') AS cc, max(new_value) FILTER (level = 'Pub' AND property = 'nSpines') AS spines, count(*) FILTER (level = 'All' AND status = 'unchanged') > 0 AS same FROM d GROUP BY file),
g AS (SELECT e.*, level, coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed, coalesce(n_changed, 0) AS n_changed, coalesce(n_unchanged, 0) AS n_unchanged, CASE WHEN level = 'Spine' THEN cc ELSE 0 END AS n_content
  FROM (SELECT *, unnest(['Pub', 'Spine', 'Mani', 'Refs', 'Mess', 'Loc']) AS level FROM e) e LEFT JOIN c USING (file, level)),
compared AS (SELECT file, level, n_added, n_removed, n_changed, n_unchanged, n_content, CASE
  WHEN level = 'Spine' AND n_added + n_removed + n_changed + cc = 0 THEN 'Spine==-N' || coalesce(spines, 'None')
  WHEN level = 'Spine' THEN concat_ws('-', 'Spine-N' || coalesce(spines, 'None'), {_mark('U', 'n_unchanged')}, {_mark('A', 'n_added')}, {_mark('R', 'n_removed')}, {_mark('OC', 'n_changed')}, {_mark('CC', 'cc')})
  WHEN level = 'Mess' THEN CASE WHEN same THEN 'Mess=!' ELSE 'Mess-' END || {_three}
  WHEN n_added + n_removed + n_changed = 0 THEN level || '==' ELSE level || '-' || {_three} END AS code FROM g)"""
_ONE_SIDE = f"WITH {_side('b')}"


@query(f"""
{_ONE_SIDE}, k AS (SELECT f, severity, 1 + CASE WHEN p % 3 <> 0 THEN p % 3 - 1 ELSE 0 END AS k FROM bd)
SELECT f AS file, coalesce(sum(k) FILTER (severity IN ('FATAL', 'ERROR')), 0)::BIGINT AS n_errors, coalesce(sum(k) FILTER (severity = 'WARNING'), 0)::BIGINT AS n_warnings,
  coalesce(sum(k) FILTER (severity IN ('FATAL', 'ERROR')), 0) = 0 AS is_clean FROM k GROUP BY f
""")
def check_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_results.outcome(_checks(spark, sf_dir, True))


@query(f"{_ONE_SIDE} SELECT severity, count(*) AS n FROM bd GROUP BY severity")
def shown_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_results.shown(check_results.messages(_checks(spark, sf_dir, True)), warnings=True).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {_COMPARED} SELECT file, n_added, n_removed, n_changed, n_unchanged, n_content, code FROM compared WHERE level = 'Spine'")
def check_spine_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_results.compare(_checks(spark, sf_dir, False), _checks(spark, sf_dir, True)).where("level = 'Spine'").drop("level")


@query(f"WITH {_COMPARED} SELECT * FROM compared")
def check_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_results.compare(_checks(spark, sf_dir, False), _checks(spark, sf_dir, True))


@query(f"WITH {_COMPARED} SELECT file, sum(n_added + n_removed + n_changed) FILTER (level IN ('Pub', 'Mani')) = 0 AS is_unchanged FROM compared GROUP BY file")
def check_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_results.unchanged(check_results.compare(_checks(spark, sf_dir, False), _checks(spark, sf_dir, True)))


@query(f"WITH {_DIFFS} SELECT * FROM d WHERE level NOT IN ('Mani', 'Mess', 'All')")
def check_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_results.differences(_checks(spark, sf_dir, False), _checks(spark, sf_dir, True)).where("level not in ('Mani', 'Mess', 'All')")


# What SQL cannot express, and streaming forms


@query()
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = docs.groupBy((F.col("doc_id") % 3).cast("string").alias("split"), F.floor(F.col("doc_id") / 10).alias("page_id")).agg(F.min("source").alias("category"), F.array_sort(F.collect_set("lang")).alias("labels"), F.count("*").alias("n_annotations"))
    return layout.diverse_sample(pages, {"0": 12, "1": 5, "2": 5})


@query("SELECT l_orderkey AS page_id, l_returnflag AS text, l_linenumber::DOUBLE AS x, l_quantity AS y, l_partkey::DOUBLE AS w, l_suppkey::DOUBLE AS h FROM lineitem WHERE l_partkey IS NOT NULL")
def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct(F.col("l_returnflag").alias("text"), F.struct(F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"), F.col("l_partkey").alias("w"), F.col("l_suppkey").alias("h")).alias("bbox"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.to_json(F.struct(F.collect_list(cell).alias("cells"))).alias("payload"))
    return layout.text_cells(rows)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""
WITH b AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM b) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"))


_PRICES = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL"


@query(_PRICES)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))

