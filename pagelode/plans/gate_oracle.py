"""The block gate as one hand-written DuckDB statement, to hold the engine's gate against.

It shares nothing with ``block_rules``: inputs, signals, scores and thresholds
are written out again, label by label. A label's score is a fold over the list of
what raises it (positive) or caps it (negative), in order; its context a sum.
"""

from __future__ import annotations

#: Inputs that the source gives as booleans, and those it gives as cells of a feature file.
BOOLEANS = """is_heading_kind is_heading_candidate contains_currency contains_date contains_path_like code_like_signal contains_clause_punctuation has_terminal_period ends_with_colon
is_caption_candidate caption_marker_signal caption_marker_starts_line near_image_object_signal caption_reference_only_signal asset_metadata_noise_signal caption_heading_conflict_signal
is_table_cell_candidate looks_like_separator looks_like_bullet looks_like_list_marker_token option_like_signal is_noise_kind is_page_number_candidate is_header_footer_candidate
is_artifact_candidate looks_like_page_number repeated_edge_candidate top_zone_candidate bottom_zone_candidate contains_url_or_email contains_email visible_url_without_annotation
technical_literal_signal identifier_like_signal sentence_like_signal citation_reference_signal receipt_line_item_signal quantity_price_signal cleanup_shell_signal
figure_reference_sentence_signal link_target_internal link_target_uri page_number_like_link is_link_only_candidate has_link_inline has_partial_link same_paragraph_candidate""".split()
FLAG_CELLS = "contains_time looks_like_address monospace_hint payment_card_signal caption_lead_in_signal toc_like_anchor_signal link_target_named wrapped_candidate".split()
NUMBERS = """word_count page_block_count line_count relative_font_size uppercase_ratio cjk_ratio repeated_text_score form_key_value_signal link_text_coverage_ratio link_overlap_ratio
model_paragraph model_heading model_table_like model_form_row model_list_item model_caption model_footer_header_noise model_separator model_link_text model_keep_as_text""".split()
NUMBER_CELLS = ["digit_ratio"]
DISTANCES = "near_annotation_distance near_link_annotation_distance near_image_distance".split()
DISTANCE_CELLS = ["near_dest_annotation_distance"]

_WHITE = r"\t-\r\x1C-\x20\x85\p{Z}"

_SIGNALS = rf"""
  regexp_replace(regexp_replace(text, '^[{_WHITE}]+', ''), '[{_WHITE}]+$', '') AS t,
  contains_currency OR contains_time OR contains_date AS money,
  contains_path_like OR code_like_signal AS path_or_code,
  is_page_number_candidate OR is_header_footer_candidate OR looks_like_page_number AS edge,
  is_heading_kind OR is_heading_candidate AS headed,
  top_zone_candidate OR bottom_zone_candidate AS in_zone,
  form_key_value_signal >= 0.5 AS key_value,
  t <> '' AND regexp_full_match(t, '[{_WHITE}•‣◦⁃∙·\x{{F0B7}}]+') AS lone_bullet,
  regexp_matches(t, '^\p{{Nd}}+(\.\p{{Nd}}+)*[{_WHITE}]+[^{_WHITE}]') AS section_number,
  cjk_ratio >= 0.6 AND regexp_matches(t, '^(第?[一二三四五六七八九十百千万零〇0-9]+[章节篇部卷]|[章节篇部卷附录])[^{_WHITE}]+$') AS cjk_section_mark,
  word_count >= 6 AND has_terminal_period AND regexp_matches(lower(t), '^\p{{Nd}}+\.[{_WHITE}]+[a-z]') AS counted_sentence,
  contains_email OR contains_url_or_email OR regexp_matches(t, '^(\+?\p{{Nd}}{{1,3}}[{_WHITE}-]?)?(\(\p{{Nd}}{{2,4}}\)|\p{{Nd}}{{2,4}})[{_WHITE}-]?\p{{Nd}}{{3,4}}[{_WHITE}-]?\p{{Nd}}{{4}}$') AS contact,
  page_block_count >= 40 AND word_count <= 2 AND NOT in_zone AND contact AS dense_contact,
  receipt_line_item_signal OR quantity_price_signal OR payment_card_signal AS receipt,
  sentence_like_signal AND NOT technical_literal_signal AS sentence,
  citation_reference_signal AND sentence AND link_text_coverage_ratio <= 0.35 AS citation,
  sentence AND NOT citation AND (contains_url_or_email OR citation_reference_signal) AS referring,
  CASE WHEN contains_url_or_email OR visible_url_without_annotation OR (repeated_edge_candidate AND repeated_text_score >= 0.5) THEN FALSE
    WHEN money AND NOT (contains_path_like OR identifier_like_signal OR option_like_signal) THEN FALSE
    WHEN (looks_like_bullet OR looks_like_list_marker_token) AND word_count >= 4 AND NOT option_like_signal THEN FALSE
    ELSE technical_literal_signal OR identifier_like_signal OR path_or_code OR option_like_signal END AS technical_text,
  link_target_internal OR link_target_named AS inner_target,
  toc_like_anchor_signal AND inner_target AS toc,
  page_number_like_link AND (word_count >= 2 OR NOT edge) AS page_link,
  link_target_uri AND NOT (toc OR page_number_like_link OR contains_path_like)
    AND (word_count >= 8 OR (word_count >= 5 AND (has_terminal_period OR contains_clause_punctuation OR ends_with_colon))) AS link_in_text,
  inner_target AND NOT (toc OR page_link OR is_link_only_candidate) AND link_text_coverage_ratio >= 0.75
    AND (word_count >= 16 OR (word_count >= 8 AND (has_terminal_period OR contains_clause_punctuation OR same_paragraph_candidate OR wrapped_candidate))) AS told_anchor,
  NOT (link_in_text OR told_anchor) AND CASE WHEN has_link_inline THEN TRUE WHEN is_link_only_candidate THEN page_link OR NOT edge
    ELSE page_link OR toc OR (link_target_uri AND link_text_coverage_ratio >= 0.55) OR (inner_target AND link_overlap_ratio >= 0.55) END AS payload,
  payload OR (link_target_uri AND link_text_coverage_ratio >= 0.45) AS linked,
  has_partial_link AND NOT is_link_only_candidate AND word_count >= 4 AND (word_count >= 7 OR contains_clause_punctuation OR has_terminal_period) AS part_link,
  NOT receipt AND (visible_url_without_annotation OR (contains_url_or_email AND word_count >= 6 AND NOT payload)) AS shown_url,
  CASE WHEN shown_url THEN 'url' WHEN link_in_text THEN 'text' WHEN told_anchor THEN 'told' WHEN part_link THEN 'part' ELSE '' END AS around,
  CASE WHEN page_link OR toc THEN TRUE WHEN edge THEN FALSE ELSE word_count <= 2 OR (word_count <= 5 AND regexp_matches(lower(t), '^(go to|see|open) ')) END AS anchor_like,
  coalesce(near_dest_annotation_distance, 1e9) AS to_dest, coalesce(near_link_annotation_distance, 1e9) AS to_link,
  caption_reference_only_signal OR caption_lead_in_signal OR asset_metadata_noise_signal OR caption_heading_conflict_signal AS no_caption,
  NOT no_caption AND (is_caption_candidate OR (caption_marker_signal AND NOT (is_header_footer_candidate OR is_page_number_candidate))
    OR (caption_marker_starts_line AND near_image_object_signal)) AS is_caption,
  word_count <= 3 AND NOT (has_terminal_period OR contains_clause_punctuation OR money OR looks_like_address OR path_or_code OR bottom_zone_candidate)
    AND (top_zone_candidate OR relative_font_size >= 1.15) AND (section_number OR cjk_section_mark) AS titled,
  NOT cleanup_shell_signal AND repeated_text_score >= 0.9 AND word_count <= 4 AND page_block_count <= 8 AND NOT has_terminal_period AS shell,
  repeated_text_score >= 0.34 AND in_zone AS repeated_in_zone,
  cjk_ratio >= 0.55 AND contains_clause_punctuation AND NOT top_zone_candidate AS cjk_clause,
  looks_like_bullet AND NOT looks_like_separator AS bullet,
  bullet AND digit_ratio >= 0.5 AND word_count <= 2 AS number_bullet,
  ends_with_colon AND word_count >= 5 AND NOT (option_like_signal OR looks_like_bullet) AS long_lead,
  ends_with_colon AND word_count BETWEEN 2 AND 3 AND NOT (top_zone_candidate OR money OR looks_like_address OR path_or_code) AS short_lead,
  NOT top_zone_candidate AND relative_font_size <= 0.95 AND word_count >= 3 AND uppercase_ratio <= 0.3 AS small_print,
  uppercase_ratio >= 0.85 AND relative_font_size <= 1.02 AND page_block_count >= 30 AS crowded_capitals,
  coalesce(near_annotation_distance, 1e9) <= 4 AND NOT linked AND word_count <= 2 AND NOT has_terminal_period AS noted,
  contains_url_or_email AND NOT citation AND NOT receipt AS url_text"""

#: Of each label, in order: what raises it, and with a minus what caps it.
_SCORES = {
    "paragraph": """CASE WHEN TRUE THEN 0.52 END, CASE WHEN headed AND looks_like_address THEN 0.72 END, CASE WHEN headed AND (small_print OR crowded_capitals) THEN 0.62 END, CASE WHEN headed AND cjk_clause THEN 0.84 END,
      CASE WHEN no_caption THEN 0.78 END, CASE WHEN long_lead THEN 0.74 END, CASE WHEN short_lead THEN 0.68 END, CASE WHEN lone_bullet THEN 0.58 END, CASE WHEN counted_sentence THEN 0.72 END,
      CASE WHEN option_like_signal THEN 0.58 END, CASE WHEN cleanup_shell_signal THEN 0.58 END, CASE WHEN citation THEN 0.84 WHEN referring THEN 0.72 END,
      CASE WHEN technical_text AND NOT sentence THEN -0.48 END, CASE WHEN receipt THEN -0.42 END, CASE around WHEN 'url' THEN 0.66 WHEN 'text' THEN 0.86 WHEN 'told' THEN 0.84 WHEN 'part' THEN 0.82 END,
      CASE WHEN url_text THEN 0.56 END, CASE WHEN looks_like_address THEN 0.72 END, CASE WHEN caption_marker_signal AND NOT no_caption THEN 0.44 END""",
    "heading": """CASE WHEN is_heading_kind THEN 0.96 WHEN is_heading_candidate THEN 0.76 WHEN titled THEN 0.82 END, CASE WHEN headed AND (money OR looks_like_address OR path_or_code) THEN -0.28 END,
      CASE WHEN headed AND (small_print OR crowded_capitals) THEN -0.34 END, CASE WHEN headed AND cjk_clause THEN -0.18 END, CASE WHEN headed AND noted THEN -0.26 END, CASE WHEN shell THEN -0.24 END,
      CASE WHEN cleanup_shell_signal THEN 0.92 END, CASE WHEN technical_text THEN -0.24 END, CASE WHEN receipt THEN -0.18 END""",
    "table_like": "CASE WHEN is_table_cell_candidate THEN 0.82 END",
    "form_row": """CASE WHEN headed AND money THEN 0.74 END, CASE WHEN key_value THEN 0.86 WHEN money THEN 0.64 END, CASE WHEN long_lead THEN -0.22 END, CASE WHEN short_lead THEN -0.18 END,
      CASE WHEN option_like_signal AND key_value THEN -0.26 END, CASE WHEN payment_card_signal THEN 0.92 WHEN receipt_line_item_signal THEN 0.90 WHEN receipt THEN 0.88 END, CASE WHEN dense_contact THEN 0.86 END""",
    "list_item": """CASE WHEN looks_like_separator THEN -0.05 END, CASE WHEN bullet THEN 0.72 END, CASE WHEN number_bullet THEN -0.16 END, CASE WHEN lone_bullet THEN -0.05 END, CASE WHEN counted_sentence THEN -0.18 END,
      CASE WHEN looks_like_list_marker_token AND NOT lone_bullet THEN 0.82 END, CASE WHEN option_like_signal AND NOT contains_path_like THEN -0.18 END, CASE WHEN technical_text THEN -0.16 END,
      CASE WHEN receipt THEN -0.10 END, CASE WHEN toc AND NOT page_link THEN -0.18 END""",
    "caption": """CASE WHEN is_caption AND near_image_object_signal THEN 0.86 WHEN is_caption THEN 0.78 WHEN caption_marker_signal THEN 0.68 END, CASE WHEN no_caption THEN -0.24 END,
      CASE WHEN toc AND NOT page_link THEN -0.20 END""",
    "footer_header_noise": """CASE WHEN number_bullet THEN 0.58 END, CASE WHEN is_noise_kind OR is_page_number_candidate OR is_header_footer_candidate OR is_artifact_candidate THEN 0.88 END,
      CASE WHEN repeated_edge_candidate OR repeated_in_zone THEN 0.94 WHEN shell THEN 0.92 END, CASE WHEN cleanup_shell_signal THEN -0.54 END, CASE WHEN technical_text THEN -0.28 END, CASE WHEN page_link THEN -0.58 END""",
    "separator": "CASE WHEN looks_like_separator THEN 0.95 END",
    "link_text": """CASE WHEN TRUE THEN 0.12 END, CASE WHEN citation THEN -0.18 END, CASE around WHEN 'url' THEN -0.22 WHEN 'text' THEN -0.20 WHEN 'told' THEN -0.20 WHEN 'part' THEN -0.30 END,
      CASE WHEN page_link THEN 0.97 WHEN toc THEN 0.95 WHEN payload THEN 0.97 WHEN anchor_like AND to_dest <= 2 THEN 0.96 WHEN anchor_like AND to_link <= 2 THEN 0.92
        WHEN link_target_uri AND link_text_coverage_ratio >= 0.45 AND word_count <= 8 THEN 0.88 WHEN anchor_like AND to_dest <= 8 THEN 0.79 END, CASE WHEN dense_contact THEN -0.34 END""",
    "keep_as_text": """CASE WHEN TRUE THEN 0.20 END, CASE WHEN headed AND path_or_code THEN 0.82 END, CASE WHEN headed AND noted THEN 0.68 END, CASE WHEN asset_metadata_noise_signal THEN 0.68 END, CASE WHEN option_like_signal THEN 0.86 END,
      CASE WHEN citation THEN -0.34 END, CASE WHEN NOT technical_text THEN NULL WHEN identifier_like_signal OR contains_path_like THEN 0.90 WHEN option_like_signal OR code_like_signal THEN 0.88 ELSE 0.86 END,
      CASE WHEN receipt THEN -0.26 END, CASE around WHEN 'url' THEN 0.72 WHEN 'part' THEN 0.44 END, CASE WHEN dense_contact THEN -0.42 END, CASE WHEN url_text THEN 0.58 END,
      CASE WHEN path_or_code OR monospace_hint OR technical_literal_signal OR identifier_like_signal THEN 0.74 END""",
}
#: Of each label, in order: what is added for its context.
_CONTEXT = {
    "paragraph": """CASE WHEN looks_like_address THEN 0.18 END, CASE WHEN same_paragraph_candidate OR wrapped_candidate THEN 0.10 END, CASE WHEN no_caption THEN 0.18 END, CASE WHEN url_text THEN 0.04 END, CASE WHEN part_link THEN 0.18 END,
      CASE WHEN link_in_text THEN 0.20 END, CASE WHEN told_anchor THEN 0.18 END, CASE WHEN citation THEN 0.24 WHEN referring THEN 0.12 END, CASE WHEN shown_url THEN 0.10 END, CASE WHEN has_terminal_period THEN 0.06 END,
      CASE WHEN option_like_signal THEN 0.04 END, CASE WHEN cjk_clause THEN 0.16 END""",
    "heading": "CASE WHEN relative_font_size >= 1.12 AND line_count <= 1 THEN 0.10 END, CASE WHEN cleanup_shell_signal THEN 0.24 END",
    "table_like": "CASE WHEN is_table_cell_candidate THEN 0.16 END",
    "form_row": "CASE WHEN money THEN 0.14 END, CASE WHEN receipt THEN 0.28 END, CASE WHEN payment_card_signal THEN 0.06 END, CASE WHEN key_value THEN 0.22 END",
    "list_item": "CASE WHEN bullet THEN 0.12 END, CASE WHEN looks_like_list_marker_token AND NOT lone_bullet THEN 0.18 END",
    "caption": "CASE WHEN is_caption THEN 0.18 WHEN caption_marker_signal THEN 0.16 END",
    "footer_header_noise": """CASE WHEN (is_page_number_candidate OR is_header_footer_candidate) AND NOT cleanup_shell_signal THEN 0.12 END,
      CASE WHEN cleanup_shell_signal THEN NULL WHEN repeated_edge_candidate THEN 0.28 WHEN shell THEN 0.24 WHEN repeated_in_zone THEN 0.18 END""",
    "separator": "CASE WHEN looks_like_separator THEN 0.20 END",
    "link_text": """CASE WHEN page_link THEN 0.28 WHEN toc THEN 0.30 WHEN payload THEN 0.24 END, CASE WHEN anchor_like AND to_dest <= 2 THEN 0.24 WHEN anchor_like AND to_link <= 2 THEN 0.20 END,
      CASE WHEN link_target_uri AND link_text_coverage_ratio >= 0.35 THEN 0.18 END, CASE WHEN anchor_like AND to_dest <= 8 THEN 0.12 END""",
    "keep_as_text": """CASE WHEN asset_metadata_noise_signal THEN 0.12 END, CASE WHEN url_text THEN 0.10 END, CASE WHEN shown_url THEN 0.14 END, CASE WHEN technical_text THEN 0.20 WHEN path_or_code THEN 0.16 END,
      CASE WHEN monospace_hint THEN 0.10 END, CASE WHEN option_like_signal THEN 0.18 END""",
}
LABELS = tuple(_SCORES)

#: (kind of case, rule weight, model weight, context weight) and for each case of the gate (least confidence, least gap).
_PRESETS = {
    "conservative": ("0.55e0", "0.30e0", "0.15e0", dict(noise=(0.65, 0.03), demoted=(0.70, 0.03), link=(0.65, 0.03), list=(0.68, 0.04), kept=(0.72, 0.05), table=(0.88, 0.10), other=(0.80, 0.08))),
    "tuned": ("0.52e0", "0.32e0", "0.16e0", dict(noise=(0.63, 0.02), demoted=(0.68, 0.03), link=(0.64, 0.03), list=(0.67, 0.04), kept=(0.70, 0.05), table=(0.87, 0.09), other=(0.79, 0.07))),
}


def _list(prefix: str) -> str:
    return "[" + ", ".join(f"{{'s': {prefix}_{x}, 'l': '{x}'}}" for x in LABELS) + "]"


def _falling(prefix: str) -> str:
    return "[" + ", ".join(f"{{'s': -{prefix}_{x}, 'l': '{x}'}}" for x in LABELS) + "]"


def gate_sql(source: str, preset: str = "conservative") -> str:
    """The gate over a FROM item that has the inputs named above, nulls among them."""
    rule, model, context, cases = _PRESETS[preset]
    named = lambda names: "COLUMNS('^(" + "|".join(names) + ")$')"
    fold = lambda parts: f"list_reduce(list_filter([0, {parts}]::DOUBLE[], lambda x: x IS NOT NULL), lambda a, x: CASE WHEN x < 0 THEN least(a, -x) ELSE greatest(a, x) END)"
    added = lambda parts: f"list_reduce(list_filter([0, {parts}]::DOUBLE[], lambda x: x IS NOT NULL), lambda a, x: a + x)"
    least = lambda k: "CASE gate_case " + " ".join(f"WHEN '{name}' THEN {v[k]}" for name, v in cases.items()) + " END"
    return f"""
WITH inputs AS (
  SELECT doc_id, line_no, coalesce(text, '') AS text, coalesce({named(BOOLEANS)}, FALSE), coalesce(nullif({named(FLAG_CELLS)}, '')::DOUBLE, 0) >= 0.5,
    coalesce({named(NUMBERS)}, 0)::DOUBLE, coalesce(nullif({named(NUMBER_CELLS)}, '')::DOUBLE, 0), {named(DISTANCES)}::DOUBLE, nullif({named(DISTANCE_CELLS)}, '')::DOUBLE FROM {source}),
signals AS (SELECT *, {_SIGNALS} FROM inputs),
scores AS (SELECT *, {', '.join(f"{fold(v)} AS rule_{k}" for k, v in _SCORES.items())}, {', '.join(f"{added(v)} AS context_{k}" for k, v in _CONTEXT.items())} FROM signals),
blends AS (SELECT *, {', '.join(f"{rule} * rule_{k} + {model} * model_{k} + {context} * context_{k} AS weighted_{k}, 0.5e0 * rule_{k} + 0.5e0 * model_{k} AS naive_{k}" for k in LABELS)} FROM scores),
ranked AS (SELECT *, {', '.join(f"list_sort({_list(p)}, 'DESC') AS {p}_down" for p in ('rule', 'model', 'weighted', 'naive'))}, list_sort({_falling('model')}) AS model_up, list_sort({_falling('weighted')}) AS weighted_up FROM blends),
tops AS (SELECT *, {', '.join(f"{p}_down[1].l AS {p}_label" for p in ('rule', 'model', 'weighted', 'naive'))}, model_down[1].s AS model_confidence, weighted_down[1].s AS weighted_best,
  model_up[2].l AS model_second, weighted_up[2].l AS weighted_second, model_down[1].s - model_down[2].s AS model_margin, weighted_down[1].s - weighted_down[2].s AS weighted_margin FROM ranked),
cases AS (SELECT *, CASE WHEN weighted_label = 'footer_header_noise' AND NOT cleanup_shell_signal AND (shell OR repeated_edge_candidate OR edge) THEN 'noise'
    WHEN weighted_label = 'paragraph' AND rule_label IN ('heading', 'form_row') AND (looks_like_address OR has_terminal_period OR same_paragraph_candidate OR wrapped_candidate OR word_count >= 6) THEN 'demoted'
    WHEN weighted_label = 'link_text' AND linked THEN 'link' WHEN weighted_label = 'list_item' AND (looks_like_bullet OR looks_like_list_marker_token) THEN 'list'
    WHEN weighted_label = 'keep_as_text' AND (path_or_code OR monospace_hint OR option_like_signal OR technical_literal_signal OR identifier_like_signal) THEN 'kept'
    WHEN weighted_label IN ('table_like', 'form_row') THEN 'table' ELSE 'other' END AS gate_case,
  concat_ws(',', CASE WHEN is_table_cell_candidate AND rule_label IN ('table_like', 'form_row') THEN 'table_geometry' END, CASE WHEN is_caption_candidate AND near_image_distance > 0 THEN 'caption_geometry' END,
    CASE WHEN payload AND rule_label = 'link_text' THEN 'link_payload' END) AS held_by,
  rule_label = 'keep_as_text' AND weighted_label = 'paragraph' AND figure_reference_sentence_signal AND sentence_like_signal AND no_caption AND NOT near_image_object_signal
    AND NOT (contains_path_like OR identifier_like_signal OR option_like_signal OR monospace_hint OR visible_url_without_annotation OR contains_url_or_email OR receipt) AS figure_sentence,
  (rule_label || '>' || weighted_label) IN ('heading>paragraph', 'heading>form_row', 'heading>footer_header_noise', 'heading>separator', 'heading>link_text', 'heading>keep_as_text', 'separator>paragraph',
    'separator>footer_header_noise', 'list_item>separator', 'list_item>footer_header_noise', 'list_item>link_text', 'paragraph>form_row', 'paragraph>table_like', 'paragraph>caption', 'paragraph>link_text',
    'paragraph>keep_as_text', 'footer_header_noise>link_text', 'form_row>paragraph', 'form_row>list_item', 'form_row>table_like', 'caption>paragraph', 'table_like>form_row', 'link_text>paragraph', 'link_text>keep_as_text') AS may_override,
  list_filter(weighted_list, lambda x: x.l = weighted_label)[1].s < 0.45 AND CASE weighted_label WHEN 'heading' THEN TRUE WHEN 'table_like' THEN TRUE WHEN 'form_row' THEN NOT (key_value OR money OR receipt)
    WHEN 'link_text' THEN NOT linked WHEN 'list_item' THEN NOT (looks_like_bullet OR looks_like_list_marker_token) ELSE FALSE END AS unsafe FROM (SELECT *, {_list('rule')} AS weighted_list FROM tops)),
decided AS (SELECT *, CASE WHEN rule_label = weighted_label THEN NULL WHEN held_by <> '' THEN held_by WHEN figure_sentence THEN NULL WHEN NOT may_override THEN 'conflict_policy'
    WHEN model_confidence < {least(0)} THEN 'model_confidence' WHEN weighted_margin < {least(1)} THEN 'weighted_margin' WHEN unsafe THEN 'precision_guard' END AS blocked_reason FROM cases)
SELECT *, CASE WHEN blocked_reason IS NULL THEN weighted_label ELSE rule_label END AS gated_label FROM decided"""
