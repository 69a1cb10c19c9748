"""Text and geometry functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 1025.0


def number_of(c: Column) -> Column:
    """null and '' are 0; junk raises under ANSI, as it should."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")).cast("double"), F.lit(0.0))


def flag_of(c: Column) -> Column:
    """A numeric feature as a boolean: at least one half."""
    return F.coalesce(c.cast("double"), F.lit(0.0)) >= 0.5


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def sigmoid(s: Column) -> Column:
    """In two branches, so that neither exponential overflows."""
    return F.when(s >= 0, 1 / (1 + F.exp(-s))).otherwise(F.exp(s) / (1 + F.exp(s)))


def bucket(value: Column, limits: Sequence[float]) -> Column:
    """Place of the first limit that value does not exceed; the number of limits if none."""
    out = F.lit(len(limits))
    for i in range(len(limits) - 1, -1, -1):
        out = F.when(value <= limits[i], F.lit(i)).otherwise(out)
    return out


TOKEN = "[A-Za-z0-9]+"
_START, _END = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"


def _length_of(text: Column, runs: str) -> Column:
    """How many characters of text lie in runs of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, runs, ""))


def char_counts(text: Column) -> dict[str, Column]:
    """Counts of characters by Unicode class: runs are cut out, and the rarer classes are counted in what is left."""
    rest, high = F.regexp_replace(text, r"\p{L}+", ""), F.regexp_replace(text, r"\p{Ll}+", "")
    return {
        "alpha": F.length(text) - F.length(rest), "digit": _length_of(rest, r"\p{Nd}+"), "upper": _length_of(high, r"\p{Lu}+"), "lower": F.length(text) - F.length(high),
        "space": _length_of(rest, r"[\s\p{Z}]+"), "punct": _length_of(rest, r"[^\p{L}\p{N}\s\p{Z}]+"),
    }


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def title_token_ratio(text: Column) -> Column:
    """Share of tokens with a capital first and lower-case letters after it."""
    return safe_ratio(count_of(text, f"{_START}[A-Z][0-9]*[a-z][a-z0-9]*{_END}"), count_of(text, TOKEN))


def all_caps_ratio(text: Column) -> Column:
    """Share of tokens that have capitals and no lower-case letters."""
    return safe_ratio(count_of(text, f"{_START}[0-9]*[A-Z][A-Z0-9]*{_END}"), count_of(text, TOKEN))


def list_marker_type(text: Column) -> Column:
    """0 none, 1 bullet, 2 number, 3 letter."""
    return F.when(text.rlike(r"^\s*[-*•]\s+"), 1).when(text.rlike(r"^\s*\(?\d+[).]\s+"), 2).when(text.rlike(r"^\s*[A-Za-z][).]\s+"), 3).otherwise(0)


#: Patterns of the text flags (fixed values).
FLAGS: dict[str, str] = {
    "starts_bullet": r"^\s*([\-*•]|[0-9]+\.)\s+",
    "starts_numbered": r"^\s*(\(?\d+[\).]|[A-Za-z][\).])\s+",
    "starts_with_alpha_marker": r"^\s*[A-Za-z][\).]\s+",
    "section_number_prefix": r"^\s*((\d+(\.\d+)+)|(\d+\.)|([A-Z]\.)|([IVXLC]+\.)|(\([A-Za-z0-9]+\)))\s+",
    "ends_colon": r":\s*$",
    "has_terminal_period": r"\.\s*$",
    "contains_url": r"https?://|www\.",
    "contains_email": r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "contains_pipe": r"\|",
    "contains_tabular_hint": r"\t|  ",
    "contains_figure_hint": r"(?i)\b(fig(ure)?|plate)\b",
    "contains_table_hint": r"(?i)\btable\b",
    "contains_form_hint": r"(?i)\b(name|date|address|phone|id|signature)\b",
    "contains_page_hint": r"(?i)\bpage\b",
}


def text_features(text: Column) -> dict[str, Column]:
    """The text features of a block: sizes, character shares, token shapes and flags. Plain expressions without arrays of tokens or lambdas."""
    text = F.coalesce(text, F.lit(""))
    chars, length, n, marker = char_counts(text), F.length(text), count_of(text, TOKEN), list_marker_type(text)
    short = n <= 6
    title, caps = F.bround(title_token_ratio(text), 6), F.bround(all_caps_ratio(text), 6)
    out = {
        "text_len": length, "word_count": n, "text_missing": ~text.rlike(r"\S"), "avg_word_len": F.bround(safe_ratio(_length_of(text, TOKEN), n), 6),
    } | {f"{k}_ratio": F.bround(safe_ratio(v, length), 6) for k, v in chars.items()} | {
        "title_token_ratio": title, "all_caps_ratio": caps, "has_long_token": text.rlike("[A-Za-z0-9]{18}"), "has_many_digits": chars["digit"] >= 6,
        "short_text": n <= 4, "very_short_text": n <= 2, "long_text": n >= 30, "token_count": n,
        "title_case_short": short & (title >= 0.6), "all_caps_short": short & (caps >= 0.6), "list_marker_type": marker, "short_line_with_marker": short & (marker > 0),
        "no_terminal_period": text.rlike(r"\S") & ~text.rlike(FLAGS["has_terminal_period"]), "contains_table_delimiters": text.rlike(r"\||\t|  "),
    }
    return out | {k: text.rlike(p) for k, p in FLAGS.items()}


def geometry_features(x: Column, y: Column, w: Column, h: Column, page_no: Column, n_tokens: Column, marker: Column, page: float = PAGE) -> dict[str, Column]:
    """Place and size of a box on a square page."""
    r = lambda c: F.bround(c, 6)
    return {
        "bbox_x_norm": r(x / page), "bbox_y_norm": r(y / page), "bbox_w_norm": r(w / page), "bbox_h_norm": r(h / page),
        "bbox_area_norm": r(w / page * (h / page)), "bbox_aspect_ratio": r(safe_ratio(w, h)),
        "near_top": y / page <= 0.15, "near_bottom": (y + h) / page >= 0.85, "near_left": x / page <= 0.12, "near_right": (x + w) / page >= 0.88,
        "center_band": ((x + w / 2) / page).between(0.2, 0.8), "page_no_norm": r(F.least(page_no / 50, F.lit(1.0))),
        "left_indent_bucket": bucket(x / page, [0.08, 0.16, 0.24, 0.32]), "relative_x_bucket": bucket(x / page, [0.15, 0.30, 0.45, 0.60, 0.75]),
        "relative_width_bucket": bucket(w / page, [0.20, 0.35, 0.50, 0.70, 0.85]), "y_position_bucket": bucket(y / page, [0.10, 0.25, 0.50, 0.75, 0.90]),
        "continuation_indent_like": (marker == 0) & (x / page >= 0.12) & (n_tokens >= 4),
    }


def bbox_of(value: Column) -> Column:
    """A struct x, y, w, h of JSON text: a list, x/y/w/h, left/top/width/height or corners; null if a part is not a number."""
    num = lambda path: F.get_json_object(value, path).try_cast("double")
    box = lambda x, y, w, h: F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))
    x0, y0 = num("$.x0"), num("$.y0")
    return F.coalesce(
        box(num("$[0]"), num("$[1]"), num("$[2]"), num("$[3]")),
        box(num("$.x"), num("$.y"), num("$.w"), num("$.h")),
        box(num("$.left"), num("$.top"), num("$.width"), num("$.height")),
        box(x0, y0, num("$.x1") - x0, num("$.y1") - y0),
    )


def number_text(c: Column) -> Column:
    """Whole numbers without a point; others with at most six places and no zeros at the end."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", ""))


def bbox_text(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Four numbers with commas; null if one is."""
    return F.concat(number_text(x), F.lit(","), number_text(y), F.lit(","), number_text(w), F.lit(","), number_text(h))


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area shared by two boxes over the area of b; 0 where a size is not positive."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    sound = (a["w"] > 0) & (a["h"] > 0) & (b["w"] > 0) & (b["h"] > 0) & (wide > 0) & (high > 0)
    return F.when(sound, wide * high / (b["w"] * b["h"])).otherwise(0.0)


def shortened(text: Column, most: int = 140) -> Column:
    """White space collapsed; longer texts end in three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 3), F.lit("...")))


def occurrences(text: Column, literal: Column) -> Column:
    """How often a literal stands in text, without overlaps; 0 for the empty literal."""
    return F.when(F.length(literal) > 0, ((F.length(text) - F.length(F.replace(text, literal, F.lit("")))) / F.length(literal)).cast("long")).otherwise(0)


def ocr_language(hint: Column) -> Column:
    """The OCR language of a language hint."""
    h = F.lower(F.coalesce(hint, F.lit("")))
    out = F.lit("eng")
    for start, name in (("es", "spa"), ("ko", "kor"), ("ja", "jpn"), ("cmn", "chi_sim"), ("zh", "chi_sim"), ("ar", "ara")):
        out = F.when(h.startswith(start), name).otherwise(out)
    return out


def split_plan(total: Column) -> Column:
    """train, validation, test pages of a total: 70, 15 and 15 in a hundred, each at least 1; halves round to even."""
    part = lambda share: F.greatest(F.bround(total * share, 0).cast("long"), F.lit(1).cast("long"))
    return F.struct(part(0.7).alias("train"), part(0.15).alias("validation"), part(0.15).alias("test"))


def tags_of(packed: Column, separator: str = ";") -> Column:
    """The tags of a packed string; null and '' have none."""
    return F.filter(F.transform(F.split(F.coalesce(packed, F.lit("")), separator), lambda t: F.trim(t)), lambda t: t != "")


def data_uri(uri: Column) -> Column:
    """mime, attributes, is_base64, charset, text and bytes of a data URI; null for others. A text in another charset than UTF-8 is left to its bytes."""
    head, body = F.regexp_extract(uri, r"^data:([^,]*),", 1), F.regexp_extract(uri, r"^data:[^,]*,(?s)(.*)$", 1)
    parts = F.split(head, ";")
    is64 = F.get(parts, F.size(parts) - 1) == "base64"
    mime = F.when(F.get(parts, F.lit(0)).rlike("^[^=/]+/[^=/]+$"), F.get(parts, F.lit(0)))
    pairs = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("key"), F.regexp_extract(p, "=(.*)$", 1).alias("value")))
    attributes = F.map_from_entries(pairs)
    raw = F.when(is64, F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(F.try_url_decode(body), "UTF-8"))
    charset = F.lower(attributes["charset"])
    text = F.when(F.coalesce(charset, F.lit("utf-8")).isin("utf-8", "us-ascii", "ascii"), F.try_validate_utf8(raw.cast("string")))
    found = F.struct(mime.alias("mime"), attributes.alias("attributes"), is64.alias("is_base64"), charset.alias("charset"), text.alias("text"), raw.alias("bytes"))
    return F.when(uri.startswith("data:") & F.contains(uri, F.lit(",")), found)


def file_uri(uri: Column) -> Column:
    """host (null if there is none) and path of a file URI without query and fragment; null for others."""
    bare = F.regexp_replace(uri, "[?#].*$", "")
    host, path = F.nullif(F.regexp_extract(bare, "^file://([^/]*)/", 1), F.lit("")), F.regexp_extract(bare, "^file:(?://[^/]*)?(/.*)$", 1)
    return F.when(uri.startswith("file:"), F.struct(host.alias("host"), F.try_url_decode(path).alias("path")))


#: What files begin with, the extensions that share such a beginning, and their media types.
_MAGIC = (
    (b"%PDF-", (("pdf", "application/pdf"),)), (b"\x89PNG\r\n\x1a\n", (("png", "image/png"),)), (b"\xff\xd8\xff", (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"))), (b"GIF8", (("gif", "image/gif"),)),
    (b"PK\x03\x04", (
        ("zip", "application/zip"), ("epub", "application/epub+zip"), ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
        ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    )),
    (b"\xd0\xcf\x11\xe0", (("xls", "application/vnd.ms-excel"), ("msg", "application/vnd.ms-outlook"))), (b"RIFF", (("wav", "audio/x-wav"),)), (b"ID3", (("mp3", "audio/mpeg"),)),
)
_TEXTS = (("html", "text/html"), ("htm", "text/html"), ("xml", "text/xml"), ("csv", "text/csv"), ("json", "application/json"), ("ipynb", "application/json"), ("md", "text/markdown"), ("txt", "text/plain"))


def stream_info(name: Column, content: Column) -> Column:
    """mimetype, extension (with its dot), charset of a file by its name and bytes: a known beginning decides, then whether it is text; null where nothing is known."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    mime, ext, known = F.lit(None).cast("string"), F.nullif(extension, F.lit("")), F.lit(False)
    for start, kinds in reversed(_MAGIC):
        here = F.substring(content, 1, len(start)) == F.lit(start)
        own, first = F.lit(kinds[0][1]), F.lit(kinds[0][0])
        for x, m in kinds:
            own, first = F.when(extension == x, m).otherwise(own), F.when(extension == x, x).otherwise(first)
        mime, ext, known = F.when(here, own).otherwise(mime), F.when(here, first).otherwise(ext), here | known
    two, three = F.substring(content, 1, 2), F.substring(content, 1, 3)
    text = F.decode(content, "ISO-8859-1")
    charset = (
        F.when(known | text.rlike("\\x00") & ~two.isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff")), F.lit(None).cast("string")).when(two == F.lit(b"\xff\xfe"), "utf-16-le").when(two == F.lit(b"\xfe\xff"), "utf-16-be")
        .when(three == F.lit(b"\xef\xbb\xbf"), "utf-8").when(~text.rlike("[\\x80-\\xff]"), "ascii").when(F.is_valid_utf8(content.cast("string")), "utf-8")
    )
    written = F.lit(None).cast("string")
    for x, m in _TEXTS:
        written = F.when(extension == x, m).otherwise(written)
    start = F.lower(F.ltrim(F.substring(text, 1, 256)))
    guessed = F.when(start.startswith("<!doctype html") | start.startswith("<html"), "text/html").when(start.startswith("<?xml"), "text/xml").otherwise("text/plain")
    return F.struct(F.coalesce(mime, F.when(charset.isNotNull(), F.coalesce(written, guessed))).alias("mimetype"), F.concat(F.lit("."), ext).alias("extension"), charset.alias("charset"))


def date_text(at: Column, code: str) -> Column:
    """A time written by a spreadsheet's number format: d, m, y, h and s runs; m beside hours or seconds is minutes."""
    import re

    parts, out = re.findall(r"d+|m+|y+|h+|s+|\.0+|[^dmyhs.]+|\.", code), []
    letters = [p for p in parts if p[0] in "dmyhs"]
    seen = -1
    for p in parts:
        seen += p[0] in "dmyhs"
        if p[0] == "m":
            clock = (seen > 0 and letters[seen - 1][0] == "h") or (seen + 1 < len(letters) and letters[seen + 1][0] == "s")
            out.append(p if clock else p.upper())
        elif p[0] == "y":
            out.append("yy" if len(p) <= 2 else "yyyy")
        elif p[0] == "h":
            out.append("H" * len(p))
        elif p.startswith(".0"):
            out.append("." + "S" * (len(p) - 1))
        else:
            out.append(p if p[0] in "ds" else "'" + p.replace("'", "''") + "'")
    return F.date_format(at, "".join(out))
