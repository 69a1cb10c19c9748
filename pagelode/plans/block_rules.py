"""Scores of text blocks by an ordered rule list, and their arbitration with a model.

Signals, rules and gates are data: SQL conditions over the columns that
``FLAGS``, ``NUMBERS`` and ``DISTANCES`` name. ``predicted`` turns them into a
few projections, so Catalyst sees plain expressions. A rule raises (``up``) or
lowers (``down``) a label's score by greatest/least with a CASE without ELSE,
which skip NULL.

Inputs may be booleans, numbers or the cells of a feature file: null and ''
are absent, which is false for a flag and 0 for a number but differs from 0 for
a distance; a number is a true flag from one half on; junk raises. A null text
is empty. Names, values and thresholds are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagelode.schemas import BLOCK_LABELS

FLAGS = (
    "is_heading_kind", "is_heading_candidate", "contains_currency", "contains_time", "contains_date", "looks_like_address", "contains_path_like", "code_like_signal",
    "contains_clause_punctuation", "has_terminal_period", "ends_with_colon", "is_caption_candidate", "caption_marker_signal", "caption_marker_starts_line",
    "near_image_object_signal", "caption_reference_only_signal", "caption_lead_in_signal", "asset_metadata_noise_signal", "caption_heading_conflict_signal", "is_table_cell_candidate",
    "looks_like_separator", "looks_like_bullet", "looks_like_list_marker_token", "option_like_signal", "is_noise_kind", "is_page_number_candidate",
    "is_header_footer_candidate", "is_artifact_candidate", "looks_like_page_number", "repeated_edge_candidate", "top_zone_candidate", "bottom_zone_candidate",
    "contains_url_or_email", "contains_email", "visible_url_without_annotation", "monospace_hint", "technical_literal_signal", "identifier_like_signal",
    "sentence_like_signal", "citation_reference_signal", "receipt_line_item_signal", "quantity_price_signal", "payment_card_signal", "cleanup_shell_signal",
    "figure_reference_sentence_signal", "toc_like_anchor_signal", "link_target_internal", "link_target_named", "link_target_uri", "page_number_like_link",
    "is_link_only_candidate", "has_link_inline", "has_partial_link", "same_paragraph_candidate", "wrapped_candidate",
)
NUMBERS = (
    "word_count", "page_block_count", "line_count", "relative_font_size", "uppercase_ratio", "digit_ratio", "cjk_ratio", "repeated_text_score", "form_key_value_signal",
    "link_text_coverage_ratio", "link_overlap_ratio",
)
#: Of these, absent differs from 0.
DISTANCES = ("near_annotation_distance", "near_dest_annotation_distance", "near_link_annotation_distance", "near_image_distance")

_MONEY = "(contains_currency OR contains_time OR contains_date)"
_EDGE_LABELS = "(is_page_number_candidate OR is_header_footer_candidate OR looks_like_page_number)"

#: In dependency order; a later signal may use earlier ones.
SIGNALS: dict[str, str] = {
    "trimmed": r"regexp_replace(text, '^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$', '')",
    "standalone_bullet": "length(trimmed) > 0 AND regexp_like(trimmed, '^[\\s\\p{Z}•‣◦⁃∙·]+$')",
    "numbered_section": "regexp_like(trimmed, '^\\p{Nd}+([.]\\p{Nd}+)*[\\s\\p{Z}]+[^\\s\\p{Z}]')",
    "cjk_section": "cjk_ratio >= 0.6e0 AND regexp_like(trimmed, '^(第?[一二三四五六七八九十百千万零〇0-9]+[章节篇部卷]|[章节篇部卷附录])[^\\s\\p{Z}]+$')",
    "numbered_sentence": "word_count >= 6 AND has_terminal_period AND regexp_like(lower(trimmed), '^\\p{Nd}+[.][\\s\\p{Z}]+[a-z]')",
    "contact_value": "contains_email OR contains_url_or_email OR regexp_like(trimmed, '^([+]?\\p{Nd}{1,3}[\\s\\p{Z}-]?)?([(]\\p{Nd}{2,4}[)]|\\p{Nd}{2,4})[\\s\\p{Z}-]?\\p{Nd}{3,4}[\\s\\p{Z}-]?\\p{Nd}{4}$')",
    "dense_form_contact": "page_block_count >= 40 AND word_count <= 2 AND NOT top_zone_candidate AND NOT bottom_zone_candidate AND contact_value",
    "technical": f"""NOT (contains_url_or_email OR visible_url_without_annotation) AND NOT (repeated_edge_candidate AND repeated_text_score >= 0.5e0)
        AND NOT ({_MONEY} AND NOT (contains_path_like OR identifier_like_signal OR option_like_signal))
        AND NOT ((looks_like_bullet OR looks_like_list_marker_token) AND NOT option_like_signal AND word_count >= 4)
        AND (technical_literal_signal OR identifier_like_signal OR contains_path_like OR code_like_signal OR option_like_signal)""",
    "sentence_paragraph": "sentence_like_signal AND NOT technical_literal_signal",
    "citation_paragraph": "citation_reference_signal AND sentence_paragraph AND link_text_coverage_ratio <= 0.35e0",
    "receipt_form": "receipt_line_item_signal OR quantity_price_signal OR payment_card_signal",
    "cleanup_heading": "cleanup_shell_signal",
    "toc_anchor": "toc_like_anchor_signal AND (link_target_internal OR link_target_named)",
    "page_anchor": f"page_number_like_link AND (word_count >= 2 OR NOT {_EDGE_LABELS})",
    "link_context": """link_target_uri AND NOT toc_anchor AND NOT page_number_like_link AND NOT contains_path_like
        AND (word_count >= 8 OR (word_count >= 5 AND (has_terminal_period OR contains_clause_punctuation OR ends_with_colon)))""",
    "narrative_anchor": """(link_target_internal OR link_target_named) AND NOT toc_anchor AND NOT page_anchor AND NOT is_link_only_candidate AND link_text_coverage_ratio >= 0.75e0
        AND (word_count >= 16 OR (word_count >= 8 AND (has_terminal_period OR contains_clause_punctuation OR same_paragraph_candidate OR wrapped_candidate)))""",
    "strong_link": f"""CASE WHEN link_context OR narrative_anchor THEN FALSE WHEN has_link_inline THEN TRUE
        WHEN is_link_only_candidate THEN NOT ({_EDGE_LABELS} AND NOT page_anchor) WHEN page_anchor OR toc_anchor THEN TRUE
        WHEN link_target_uri AND link_text_coverage_ratio >= 0.55e0 THEN TRUE ELSE (link_target_internal OR link_target_named) AND link_overlap_ratio >= 0.55e0 END""",
    "partial_link": "has_partial_link AND NOT is_link_only_candidate AND word_count >= 4 AND (word_count >= 7 OR contains_clause_punctuation OR has_terminal_period)",
    "url_boundary": "NOT receipt_form AND (visible_url_without_annotation OR (contains_url_or_email AND NOT strong_link AND word_count >= 6))",
    "caption_negative": "caption_reference_only_signal OR caption_lead_in_signal OR asset_metadata_noise_signal OR caption_heading_conflict_signal",
    "caption_positive": """NOT caption_negative AND (is_caption_candidate OR (caption_marker_signal AND NOT (is_header_footer_candidate OR is_page_number_candidate))
        OR (caption_marker_starts_line AND near_image_object_signal))""",
    "short_title": f"""NOT (has_terminal_period OR contains_clause_punctuation) AND NOT ({_MONEY} OR looks_like_address OR contains_path_like OR code_like_signal)
        AND word_count <= 3 AND NOT bottom_zone_candidate AND (top_zone_candidate OR relative_font_size >= 1.15e0) AND (numbered_section OR cjk_section)""",
    "repeated_shell": "NOT cleanup_heading AND repeated_text_score >= 0.9e0 AND word_count <= 4 AND page_block_count <= 8 AND NOT has_terminal_period",
    "noise_evidence": f"NOT cleanup_heading AND (repeated_shell OR repeated_edge_candidate OR {_EDGE_LABELS})",
    "demote_evidence": "looks_like_address OR has_terminal_period OR same_paragraph_candidate OR wrapped_candidate OR word_count >= 6",
    "short_anchor": f"""CASE WHEN page_anchor OR toc_anchor THEN TRUE WHEN {_EDGE_LABELS} THEN FALSE WHEN word_count <= 2 THEN TRUE
        ELSE word_count <= 5 AND regexp_like(lower(trimmed), '^(go to |see |open )') END""",
    "link_evidence": "strong_link OR (link_target_uri AND link_text_coverage_ratio >= 0.45e0)",
    "list_evidence": "looks_like_bullet OR looks_like_list_marker_token",
    "keep_evidence": "contains_path_like OR code_like_signal OR monospace_hint OR option_like_signal OR technical_literal_signal OR identifier_like_signal",
    "dest_2": "coalesce(near_dest_annotation_distance <= 2, FALSE)", "dest_8": "coalesce(near_dest_annotation_distance <= 8, FALSE)",
    "link_annotation_2": "coalesce(near_link_annotation_distance <= 2, FALSE)", "annotation_4": "coalesce(near_annotation_distance <= 4, FALSE)",
    "headed": "is_heading_kind OR is_heading_candidate",
}

_P, _H, _T, _F, _L, _C, _N, _S, _K, _X = "paragraph", "heading", "table_like", "form_row", "list_item", "caption", "footer_header_noise", "separator", "keep_as_text", "link_text"
_LINK_PICK = [
    ("page_anchor", 0.97), ("toc_anchor", 0.95), ("strong_link", 0.97), ("dest_2 AND short_anchor", 0.96), ("link_annotation_2 AND short_anchor", 0.92),
    ("link_target_uri AND link_text_coverage_ratio >= 0.45e0 AND word_count <= 8", 0.88), ("dest_8 AND short_anchor", 0.79),
]
_CONTEXT_PICK = ["url_boundary", "link_context", "narrative_anchor", "partial_link"]
_NOT_CAPPED = "(contains_currency OR contains_time OR contains_date OR looks_like_address OR contains_path_like OR code_like_signal)"


def _first(conditions: list[str], i: int) -> str:
    """The i-th condition where none before it holds."""
    return " AND ".join([f"NOT ({c})" for c in conditions[:i]] + [f"({conditions[i]})"])


#: (condition, label, 'up' or 'down', score) in order.
RULES: list[tuple[str, str, str, float]] = [
    ("TRUE", _P, "up", 0.52), ("TRUE", _K, "up", 0.20), ("TRUE", _X, "up", 0.12),
    ("is_heading_kind", _H, "up", 0.96), ("NOT is_heading_kind AND is_heading_candidate", _H, "up", 0.76),
    (f"headed AND {_MONEY}", _H, "down", 0.28), (f"headed AND {_MONEY}", _F, "up", 0.74),
    ("headed AND looks_like_address", _H, "down", 0.28), ("headed AND looks_like_address", _P, "up", 0.72),
    ("headed AND (contains_path_like OR code_like_signal)", _H, "down", 0.28), ("headed AND (contains_path_like OR code_like_signal)", _K, "up", 0.82),
    *[(f"headed AND {c}", label, way, v) for c, low, up, high in (
        ("NOT top_zone_candidate AND relative_font_size <= 0.95e0 AND word_count >= 3 AND uppercase_ratio <= 0.3e0", 0.34, _P, 0.62),
        ("uppercase_ratio >= 0.85e0 AND relative_font_size <= 1.02e0 AND page_block_count >= 30", 0.34, _P, 0.62),
        ("cjk_ratio >= 0.55e0 AND contains_clause_punctuation AND NOT top_zone_candidate", 0.18, _P, 0.84),
        ("annotation_4 AND NOT link_evidence AND word_count <= 2 AND NOT has_terminal_period", 0.26, _K, 0.68),
    ) for label, way, v in ((_H, "down", low), (up, "up", high))],
    ("NOT headed AND short_title", _H, "up", 0.82),
    ("caption_positive AND near_image_object_signal", _C, "up", 0.86), ("caption_positive AND NOT near_image_object_signal", _C, "up", 0.78),
    ("NOT caption_positive AND caption_marker_signal", _C, "up", 0.68),
    ("caption_negative", _P, "up", 0.78), ("caption_negative", _C, "down", 0.24), ("caption_negative AND asset_metadata_noise_signal", _K, "up", 0.68),
    ("is_table_cell_candidate", _T, "up", 0.82),
    ("form_key_value_signal >= 0.5e0", _F, "up", 0.86), (f"form_key_value_signal < 0.5e0 AND {_MONEY}", _F, "up", 0.64),
    *[("ends_with_colon AND word_count >= 5 AND NOT option_like_signal AND NOT looks_like_bullet", *x) for x in ((_P, "up", 0.74), (_F, "down", 0.22))],
    *[(f"ends_with_colon AND word_count >= 2 AND word_count <= 3 AND NOT top_zone_candidate AND NOT {_NOT_CAPPED}", *x) for x in ((_P, "up", 0.68), (_F, "down", 0.18))],
    ("looks_like_separator", _S, "up", 0.95), ("looks_like_separator", _L, "down", 0.05),
    ("looks_like_bullet AND NOT looks_like_separator", _L, "up", 0.72),
    *[("looks_like_bullet AND NOT looks_like_separator AND digit_ratio >= 0.5e0 AND word_count <= 2", *x) for x in ((_L, "down", 0.16), (_N, "up", 0.58))],
    ("standalone_bullet", _P, "up", 0.58), ("standalone_bullet", _L, "down", 0.05), ("numbered_sentence", _P, "up", 0.72), ("numbered_sentence", _L, "down", 0.18),
    ("looks_like_list_marker_token AND NOT standalone_bullet", _L, "up", 0.82),
    ("option_like_signal", _K, "up", 0.86), ("option_like_signal", _P, "up", 0.58), ("option_like_signal AND NOT contains_path_like", _L, "down", 0.18),
    ("option_like_signal AND form_key_value_signal >= 0.5e0", _F, "down", 0.26),
    ("is_noise_kind OR is_page_number_candidate OR is_header_footer_candidate OR is_artifact_candidate", _N, "up", 0.88),
    *[(_first(["repeated_edge_candidate OR (repeated_text_score >= 0.34e0 AND (top_zone_candidate OR bottom_zone_candidate))", "repeated_shell"], i), _N, "up", v) for i, v in ((0, 0.94), (1, 0.92))],
    ("repeated_shell", _H, "down", 0.24), ("cleanup_heading", _H, "up", 0.92), ("cleanup_heading", _P, "up", 0.58), ("cleanup_heading", _N, "down", 0.54),
    ("citation_paragraph", _P, "up", 0.84), ("citation_paragraph", _K, "down", 0.34), ("citation_paragraph", _X, "down", 0.18),
    ("NOT citation_paragraph AND sentence_paragraph AND (contains_url_or_email OR citation_reference_signal)", _P, "up", 0.72),
    ("technical AND (identifier_like_signal OR contains_path_like)", _K, "up", 0.90), ("technical AND (option_like_signal OR code_like_signal)", _K, "up", 0.88), ("technical", _K, "up", 0.86),
    ("technical AND NOT sentence_paragraph AND NOT citation_paragraph", _P, "down", 0.48), ("technical", _H, "down", 0.24), ("technical", _L, "down", 0.16), ("technical", _N, "down", 0.28),
    ("receipt_form AND payment_card_signal", _F, "up", 0.92), ("receipt_form AND receipt_line_item_signal", _F, "up", 0.90), ("receipt_form", _F, "up", 0.88),
    *[("receipt_form", label, "down", v) for label, v in ((_P, 0.42), (_K, 0.26), (_L, 0.10), (_H, 0.18))],
    *[(_first(_CONTEXT_PICK, i), *x) for i, effects in enumerate((
        ((_P, "up", 0.66), (_K, "up", 0.72), (_X, "down", 0.22)), ((_P, "up", 0.86), (_X, "down", 0.20)), ((_P, "up", 0.84), (_X, "down", 0.20)),
        ((_P, "up", 0.82), (_K, "up", 0.44), (_X, "down", 0.30)))) for x in effects],
    *[(_first([c for c, _ in _LINK_PICK], i), _X, "up", v) for i, (_, v) in enumerate(_LINK_PICK)],
    (_first([c for c, _ in _LINK_PICK], 0), _N, "down", 0.58), (_first([c for c, _ in _LINK_PICK], 1), _L, "down", 0.18), (_first([c for c, _ in _LINK_PICK], 1), _C, "down", 0.20),
    ("dense_form_contact", _F, "up", 0.86), ("dense_form_contact", _X, "down", 0.34), ("dense_form_contact", _K, "down", 0.42),
    *[("contains_url_or_email AND NOT citation_paragraph AND NOT receipt_form", label, "up", v) for label, v in ((_K, 0.58), (_P, 0.56))],
    ("contains_path_like OR code_like_signal OR monospace_hint OR technical_literal_signal OR identifier_like_signal", _K, "up", 0.74),
    ("looks_like_address", _P, "up", 0.72), ("caption_marker_signal AND NOT caption_negative", _P, "up", 0.44),
]

#: (condition, label, addend) in the order of the sums.
CONTEXT: list[tuple[str, str, float]] = [
    ("looks_like_address", _P, 0.18), (_MONEY, _F, 0.14), ("receipt_form", _F, 0.28), ("receipt_form AND payment_card_signal", _F, 0.06), ("looks_like_separator", _S, 0.20),
    ("is_table_cell_candidate", _T, 0.16), ("form_key_value_signal >= 0.5e0", _F, 0.22), ("(is_page_number_candidate OR is_header_footer_candidate) AND NOT cleanup_heading", _N, 0.12),
    ("looks_like_bullet AND NOT looks_like_separator", _L, 0.12), ("looks_like_list_marker_token AND NOT standalone_bullet", _L, 0.18),
    ("relative_font_size >= 1.12e0 AND line_count <= 1", _H, 0.10), ("cleanup_heading", _H, 0.24), ("same_paragraph_candidate OR wrapped_candidate", _P, 0.10),
    ("caption_positive", _C, 0.18), ("NOT caption_positive AND caption_marker_signal", _C, 0.16), ("caption_negative", _P, 0.18), ("caption_negative AND asset_metadata_noise_signal", _K, 0.12),
    *[("contains_url_or_email AND NOT citation_paragraph AND NOT receipt_form", label, v) for label, v in ((_K, 0.10), (_P, 0.04))],
    *[(_first(["page_anchor", "toc_anchor", "strong_link"], i), _X, v) for i, v in enumerate((0.28, 0.30, 0.24))],
    *[(_first(["dest_2 AND short_anchor", "link_annotation_2 AND short_anchor"], i), _X, v) for i, v in enumerate((0.24, 0.20))],
    ("link_target_uri AND link_text_coverage_ratio >= 0.35e0", _X, 0.18), ("dest_8 AND short_anchor", _X, 0.12), ("partial_link", _P, 0.18), ("link_context", _P, 0.20),
    ("narrative_anchor", _P, 0.18), ("citation_paragraph", _P, 0.24), ("NOT citation_paragraph AND sentence_paragraph AND (contains_url_or_email OR citation_reference_signal)", _P, 0.12),
    ("url_boundary", _P, 0.10), ("url_boundary", _K, 0.14),
    *[(_first(["repeated_edge_candidate AND NOT cleanup_heading", "repeated_shell", "repeated_text_score >= 0.34e0 AND (top_zone_candidate OR bottom_zone_candidate) AND NOT cleanup_heading"], i), _N, v)
      for i, v in enumerate((0.28, 0.24, 0.18))],
    ("technical", _K, 0.20), ("NOT technical AND (contains_path_like OR code_like_signal)", _K, 0.16), ("monospace_hint", _K, 0.10), ("has_terminal_period", _P, 0.06),
    ("option_like_signal", _K, 0.18), ("option_like_signal", _P, 0.04), ("cjk_ratio >= 0.55e0 AND contains_clause_punctuation AND NOT top_zone_candidate", _P, 0.16),
]

ALLOWED = {
    _H: (_P, _F, _N, _S, _X, _K), _S: (_P, _N), _L: (_S, _N, _X), _P: (_F, _T, _C, _X, _K), _N: (_X,), _F: (_P, _L, _T), _C: (_P,), _T: (_F,), _X: (_P, _K),
}
#: Weights of rule, model and context, and (confidence, gap) in the order of the gates.
PRESETS = {
    "conservative": ((0.55, 0.30, 0.15), ((0.65, 0.03), (0.70, 0.03), (0.65, 0.03), (0.68, 0.04), (0.72, 0.05), (0.88, 0.10), (0.80, 0.08))),
    "tuned": ((0.52, 0.32, 0.16), ((0.63, 0.02), (0.68, 0.03), (0.64, 0.03), (0.67, 0.04), (0.70, 0.05), (0.87, 0.09), (0.79, 0.07))),
}
GATES = (
    f"weighted_label = '{_N}' AND noise_evidence", f"weighted_label = '{_P}' AND rule_label IN ('{_H}', '{_F}') AND demote_evidence", f"weighted_label = '{_X}' AND link_evidence",
    f"weighted_label = '{_L}' AND list_evidence", f"weighted_label = '{_K}' AND keep_evidence", f"weighted_label IN ('{_T}', '{_F}')", "TRUE",
)
_FIGURE = f"""rule_label = '{_K}' AND weighted_label = '{_P}' AND figure_reference_sentence_signal AND sentence_like_signal AND caption_negative AND NOT caption_positive
    AND NOT near_image_object_signal AND NOT (contains_path_like OR identifier_like_signal OR option_like_signal OR monospace_hint OR visible_url_without_annotation
    OR contains_url_or_email OR payment_card_signal OR quantity_price_signal OR receipt_line_item_signal)"""


def _scores() -> dict[str, str]:
    """rule_<label>: one nested greatest/least for each label."""
    out = {label: "0e0" for label in BLOCK_LABELS}
    for condition, label, way, value in RULES:
        out[label] = f"{'greatest' if way == 'up' else 'least'}({out[label]}, CASE WHEN {condition} THEN {value}e0 END)"
    return {f"rule_{label}": sql for label, sql in out.items()}


def _context() -> dict[str, str]:
    terms: dict[str, list[str]] = {label: ["0e0"] for label in BLOCK_LABELS}
    for condition, label, value in CONTEXT:
        terms[label].append(f"CASE WHEN {condition} THEN {value}e0 ELSE 0e0 END")
    return {f"context_{label}": " + ".join(sql) for label, sql in terms.items()}


def _top(prefix: str, labels: tuple[str, ...] = BLOCK_LABELS) -> tuple[str, str]:
    """(best score, its label: the last by name of equals)."""
    best = f"greatest({', '.join(prefix + x for x in labels)})"
    return best, "CASE " + " ".join(f"WHEN {prefix}{x} = {best} THEN '{x}'" for x in sorted(labels, reverse=True)[:-1]) + f" ELSE '{min(labels)}' END"


def _others(prefix: str, label: str, labels: tuple[str, ...] = BLOCK_LABELS) -> str:
    """The best score among the labels other than ``label``."""
    return f"greatest({', '.join(f"CASE WHEN {label} = '{x}' THEN -1e0 ELSE {prefix}{x} END" for x in labels)})"


def _first_by_name(prefix: str, best: str, labels: tuple[str, ...] = BLOCK_LABELS) -> str:
    """The first label by name that has the score ``best``."""
    return "CASE " + " ".join(f"WHEN {prefix}{x} = {best} THEN '{x}'" for x in sorted(labels)) + " END"


def _second_label(prefix: str, first: str, second: str, labels: tuple[str, ...] = BLOCK_LABELS) -> str:
    """The label after ``first`` in falling order of score, then by name."""
    return "CASE " + " ".join(f"WHEN {first} <> '{x}' AND {prefix}{x} = {second} THEN '{x}'" for x in sorted(labels)) + " END"


def stages(preset: str = "conservative") -> list[dict[str, str]]:
    """Projections, one after another, from features and model_<label> scores to the five strategies' labels."""
    (rule, model, context), gates = PRESETS[preset]
    combined = {f"weighted_{x}": f"{rule}e0 * rule_{x} + {model}e0 * model_{x} + {context}e0 * context_{x}" for x in BLOCK_LABELS}
    naive = {f"naive_{x}": f"0.5e0 * rule_{x} + 0.5e0 * model_{x}" for x in BLOCK_LABELS}
    pick = lambda k: "CASE " + " ".join(f"WHEN {c} THEN {v[k]}e0" for c, v in zip(GATES, gates)) + " END"
    allowed = " OR ".join(f"(rule_label = '{a}' AND weighted_label IN ({', '.join(repr(b) for b in bs)}))" for a, bs in ALLOWED.items())
    blocked = f"""concat_ws(',', CASE WHEN is_table_cell_candidate AND rule_label IN ('{_T}', '{_F}') THEN 'table_geometry' END,
        CASE WHEN is_caption_candidate AND coalesce(near_image_distance > 0, FALSE) THEN 'caption_geometry' END, CASE WHEN rule_label = '{_X}' AND strong_link THEN 'link_payload' END)"""
    weak = " OR ".join((
        f"(weighted_label = '{_H}' AND rule_{_H} < 0.45e0)", f"(weighted_label = '{_T}' AND rule_{_T} < 0.45e0)",
        f"(weighted_label = '{_F}' AND rule_{_F} < 0.45e0 AND NOT (form_key_value_signal >= 0.5e0 OR {_MONEY} OR receipt_form))",
        f"(weighted_label = '{_X}' AND rule_{_X} < 0.45e0 AND NOT link_evidence)", f"(weighted_label = '{_L}' AND rule_{_L} < 0.45e0 AND NOT list_evidence)",
    ))
    reason = f"""CASE WHEN rule_label = weighted_label THEN NULL WHEN hard_constraints <> '' THEN hard_constraints WHEN {_FIGURE} THEN NULL WHEN NOT ({allowed}) THEN 'conflict_policy'
        WHEN model_confidence < least_confidence THEN 'model_confidence' WHEN weighted_margin < least_gap THEN 'weighted_margin' WHEN {weak} THEN 'precision_guard' END"""
    tops = {p: _top(f"{p}_") for p in ("rule", "model", "weighted", "naive")}
    return [
        *[{k: v} for k, v in SIGNALS.items()],
        _scores() | _context(),
        combined | naive,
        {f"{p}_label": t[1] for p, t in tops.items()} | {"model_confidence": tops["model"][0], "weighted_best": tops["weighted"][0]},
        {"weighted_next": _others("weighted_", "weighted_label"), "model_next": _others("model_", "model_label"),
         "weighted_first": _first_by_name("weighted_", "weighted_best"), "model_first": _first_by_name("model_", "model_confidence"),
         "least_confidence": pick(0), "least_gap": pick(1), "hard_constraints": blocked},
        {"weighted_margin": "weighted_best - weighted_next", "model_margin": "model_confidence - model_next",
         "weighted_second": _second_label("weighted_", "weighted_first", "weighted_next"), "model_second": _second_label("model_", "model_first", "model_next")},
        {"blocked_reason": reason},
        {"gated_label": "CASE WHEN blocked_reason IS NULL THEN weighted_label ELSE rule_label END"},
    ]


def _merged(steps: list[dict[str, str]]) -> list[dict[str, str]]:
    """Steps joined where none uses another's columns."""
    import re

    out: list[dict[str, str]] = [{}]
    for step in steps:
        used = set(re.findall(r"\w+", " ".join(step.values())))
        # the first layer after every layer that this step reads
        at = max([i + 1 for i, layer in enumerate(out) if used & set(layer)], default=0)
        if at == len(out):
            out.append({})
        out[at] = out[at] | step
    return out


def _input(features: DataFrame, name: str, kind: str) -> str:
    """SQL of an input column as a flag, a number or a distance; a column that is not there counts as absent."""
    absent = {"flag": "FALSE", "number": "0e0", "distance": "cast(null as double)"}[kind]
    if name not in features.columns:
        return f"{absent} as `{name}`"
    held = features.schema[name].dataType.typeName()
    if held == "boolean":
        value = f"coalesce(`{name}`, FALSE)" if kind == "flag" else f"cast(`{name}` as int) * 1e0"
        return f"{value} as `{name}`" if kind != "number" else f"coalesce({value}, 0e0) as `{name}`"
    value = f"cast(nullif(`{name}`, '') as double)" if held == "string" else f"cast(`{name}` as double)"
    return f"{dict(flag=f'coalesce({value}, 0e0) >= 0.5e0', number=f'coalesce({value}, 0e0)', distance=value)[kind]} as `{name}`"


def predicted(features: DataFrame, preset: str = "conservative") -> DataFrame:
    """features with signals, scores and the labels of the strategies rule, model, weighted, naive and gated.

    Inputs come back as flags and numbers. Further columns are kept, but one that
    is named like a result is replaced by it.
    """
    kinds = {c: "flag" for c in FLAGS} | {c: "number" for c in (*NUMBERS, *(f"model_{x}" for x in BLOCK_LABELS))} | {c: "distance" for c in DISTANCES}
    layers = _merged(stages(preset))
    made = {name for layer in layers for name in layer}
    kept = [f"`{c}`" for c in features.columns if c not in kinds and c not in made and c != "text"]
    text = "coalesce(cast(text as string), '') as text" if "text" in features.columns else "'' as text"
    df = features.selectExpr(*kept, text, *[_input(features, c, kind) for c, kind in kinds.items()])
    for layer in layers:
        df = df.selectExpr("*", *[f"{sql.replace(chr(92), chr(92) * 2)} as {name}" for name, sql in layer.items()])
    return df
