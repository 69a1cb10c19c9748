"""Whole documents and their lines: Markdown tables, assertions, OCR words, previews, HTML text."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions.text import occurrences, ocr_language, tags_of


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def table_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, table_no, line_no, cells of Markdown table rows; separator rows end no table and are dropped. A run of consecutive rows is a table."""
    s = F.trim("line")
    marked = rows.withColumn("_t", F.coalesce((F.length(s) > 1) & s.startswith("|") & s.endswith("|"), F.lit(False)))
    w = W.partitionBy(key).orderBy("line_no")
    start = F.col("_t") & ~F.coalesce(F.lag("_t").over(w), F.lit(False))
    runs = marked.withColumn("_s", start).withColumn("table_no", F.sum(F.col("_s").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_t")
    body = runs.where(~F.trim("line").rlike(r"^[|\- ]+$"))
    inner = F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\|", ""), r"\|$", "")
    return body.select(key, "table_no", "line_no", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def table_checks(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, table_no, n_rows, n_cols, reason (ok, too_few_rows, too_few_columns or ragged)."""
    out = cells.groupBy(key, "table_no").agg(F.count("*").alias("n_rows"), F.min(F.size("cells")).alias("_a"), F.max(F.size("cells")).alias("n_cols"))
    reason = F.when(F.col("n_rows") < 2, "too_few_rows").when(F.col("n_cols") < 2, "too_few_columns").when(F.col("_a") != F.col("n_cols"), "ragged").otherwise("ok")
    return out.select(key, "table_no", "n_rows", "n_cols", reason.alias("reason"))


def merge_numbering(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with an isolated ``.N`` joined to the next line that is not blank, at most two further; the line taken in goes."""
    w = W.partitionBy(key).orderBy("line_no")
    part = F.coalesce(F.trim("line").rlike(r"^\.\d+$"), F.lit(False))
    one, two = F.trim(F.lead("line", 1).over(w)), F.trim(F.lead("line", 2).over(w))
    step = F.when(part & (F.length(one) > 0), 1).when(part & (F.length(two) > 0), 2)
    marked = rows.withColumn("_step", step).withColumn("line", F.when(step == 1, F.concat(F.trim("line"), F.lit(" "), one)).when(step == 2, F.concat(F.trim("line"), F.lit(" "), two)).otherwise(F.col("line")))
    gone = (F.lag("_step", 1).over(w) == 1) | (F.lag("_step", 2).over(w) == 2)
    return marked.withColumn("_gone", F.coalesce(gone, F.lit(False))).where("not _gone").drop("_step", "_gone")


def isolated_numbers(text: Column) -> Column:
    """How many lines hold nothing but a partial number such as ``.1``."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?m)^[ \t]*\.\d+[ \t]*$"))


def assertions(docs: DataFrame, rules: DataFrame, on: str, text: str = "text") -> DataFrame:
    """on, literal, kind, n, passed: rules (on, literal, kind must_include or must_not_include) against the documents of the same name."""
    n = occurrences(F.coalesce(F.col(text), F.lit("")), F.col("literal"))
    out = rules.join(docs.select(on, text), on, "left").withColumn("n", n)
    return out.select(on, "literal", "kind", "n", F.when(F.col("kind") == "must_include", F.col("n") > 0).otherwise(F.col("n") == 0).alias("passed"))


def asserted(docs: DataFrame, rules: DataFrame, on: str, text: str = "text") -> DataFrame:
    """on, literal, kind, n, passed: as ``assertions``, but each rule once, over all documents of the same name together."""
    out = assertions(docs, rules, on, text).groupBy(on, "literal", "kind").agg(F.sum("n").alias("n"))
    return out.withColumn("passed", F.when(F.col("kind") == "must_include", F.col("n") > 0).otherwise(F.col("n") == 0))


def all_included(text: Column, literals: Column) -> Column:
    return F.forall(literals, lambda x: F.contains(text, x))


def golden(actual: DataFrame, expected: DataFrame, key: str, text: str = "text", most_lines: int = 2) -> DataFrame:
    """key, line_delta, pipe_delta, rule_delta, passed: texts against golden ones by counts of lines, bars and rules."""
    count = lambda c: F.struct(F.size(F.split(c, "\n")).alias("n"), occurrences(c, F.lit("|")).alias("p"), occurrences(c, F.lit("---")).alias("r"))
    out = actual.select(key, count(F.col(text)).alias("a")).join(expected.select(key, count(F.col(text)).alias("e")), key)
    out = out.select(key, F.abs(F.col("a.n") - F.col("e.n")).alias("line_delta"), F.abs(F.col("a.p") - F.col("e.p")).alias("pipe_delta"), F.abs(F.col("a.r") - F.col("e.r")).alias("rule_delta"))
    return out.withColumn("passed", (F.col("line_delta") <= most_lines) & (F.col("pipe_delta") == 0) & (F.col("rule_delta") == 0))


def in_order(text: Column, sections: list[str]) -> Column:
    """Whether all sections stand in text, each after the one before."""
    places = [F.locate(s, text) for s in sections]
    out = F.lit(True) if not places else places[0] > 0
    for a, b in zip(places, places[1:]):
        out = out & (b > a)
    return out


def text_volume(text: Column) -> dict[str, Column]:
    """Lines that are not blank, words, and characters other than white space; words and digits are Unicode's."""
    return {
        "n_lines": F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))),
        "n_words": F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))),
        "n_nonspace": F.length(F.regexp_replace(text, r"\s", "")),
    }


def preview_status(docs: DataFrame, languages: tuple[str, ...] = ("eng", "spa")) -> DataFrame:
    """docs (extension, language, scenario, tags, text) with ``status``: skipped, not_run, weak or pass; and volumes."""
    out = docs.withColumns(text_volume(F.coalesce(F.col("text"), F.lit("")))).withColumn("ocr_language", ocr_language(F.col("language")))
    quiet = (F.col("scenario") == "negative") | F.exists(tags_of(F.col("tags")), lambda t: t.isin("no_text", "text_too_sparse"))
    enough = (F.col("n_nonspace") >= 160) | (F.col("n_words") >= 30) | (F.col("n_lines") >= 6)
    status = (
        F.when(F.lower("extension") == "pdf", "skipped").when(~F.lower("extension").isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "skipped")
        .when(~F.col("ocr_language").isin("eng", *languages), "not_run").when(F.col("text").isNull(), "not_run")
        .when(F.col("n_nonspace") == 0, F.when(F.coalesce(quiet, F.lit(False)), "pass").otherwise("weak")).when(enough, "pass").otherwise("weak")
    )
    return out.withColumn("status", status)


OCR_LINE = ("page_num", "block_num", "par_num", "line_num")


def ocr_lines(words: DataFrame, image: str = "image") -> DataFrame:
    """image, line key, text (words in order), conf (mean of words), left, top, right, bottom. Only level-5 rows with text count."""
    w = words.where((F.col("level") == 5) & (F.trim("text") != ""))
    order = F.array_sort(F.collect_list(F.struct("word_num", "text")))  # the words of one line
    return w.groupBy(image, *OCR_LINE).agg(
        F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"), F.avg("conf").alias("conf"), F.min("left").alias("left"), F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
    )


def split_columns(words: DataFrame, image: str = "image", gap: int = 60) -> DataFrame:
    """image, column_no, line key, text: lines cut where words lie ``gap`` apart. Their order is by image, column_no and line key."""
    w = words.where((F.col("level") == 5) & (F.trim("text") != ""))
    line = W.partitionBy(image, *OCR_LINE).orderBy("left", "word_num")
    wide = F.coalesce(F.col("left") - F.lag(F.col("left") + F.col("width")).over(line) >= gap, F.lit(False))
    cut = w.withColumn("_wide", wide).withColumn("column_no", F.sum(F.col("_wide").cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    order = F.array_sort(F.collect_list(F.struct("left", "word_num", "text")))
    return cut.groupBy(image, "column_no", *OCR_LINE).agg(F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"))


def block_kind(text: Column, n_lines: Column) -> Column:
    """What a block of OCR lines looks like. The rules are inferred from samples and approximate."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^([-*•]|\d+[.)]|[A-Za-z][.)])\s+\S"), "ListItem").when(t.rlike(r"(?i)^(figure|fig\.|table)\s*\d+"), "CaptionLike")
        .when(t.rlike(r"^[^:]{1,40}:\s+\S"), "KeyValueLike").when(t.rlike(r"\S\s{2,}\S|\S\s\|\s\S"), "TableLike")
        .when((n_lines <= 1) & (F.length(t) <= 60) & ~t.rlike(r"[.!?]$") & t.rlike(r"^[A-Z0-9]"), "Heading").otherwise("Paragraph")
    )


def ocr_blocks(rows: DataFrame, image: str = "image") -> DataFrame:
    """image, page_num, block_num, text, conf (mean of line means), n_lines, kind, of ocr_lines without page-number lines."""
    kept = rows.where(~F.trim("text").rlike(r"(?i)^(page\s+)?\d+(\s*(/|of)\s*\d+)?$"))
    order = F.array_sort(F.collect_list(F.struct("par_num", "line_num", "text")))
    out = kept.groupBy(image, "page_num", "block_num").agg(F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"), F.avg("conf").alias("conf"), F.count("*").alias("n_lines"))
    return out.withColumn("kind", block_kind(F.col("text"), F.col("n_lines")))


def markdown_preview(blocks: DataFrame, image: str = "image") -> DataFrame:
    """image, markdown: headings marked, blocks parted by blank lines."""
    part = F.when(F.col("kind") == "Heading", F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    order = F.array_sort(F.collect_list(F.struct("page_num", "block_num", part.alias("part"))))
    return blocks.groupBy(image).agg(F.array_join(F.transform(order, lambda x: x["part"]), "\n\n").alias("markdown"))


def html_text(html: Column) -> Column:
    """Text of HTML without scripts, styles, comments and tags; named and numeric characters are written out, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for code, char in _NAMED:
        bare = F.replace(bare, F.lit(code), F.lit(char))
    numbered = F.array_distinct(F.regexp_extract_all(bare, F.lit("&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))
    bare = F.aggregate(numbered, bare, lambda text, e: F.replace(text, e, _character(e)))
    return F.trim(F.regexp_replace(F.replace(bare, F.lit("&amp;"), F.lit("&")), r"\s+", " "))


#: Named characters of HTML that texts use most; the ampersand comes last of all.
_NAMED = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&bull;", "•"), ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&euro;", "€"), ("&laquo;", "«"), ("&raquo;", "»"),
)


def _character(entity: Column) -> Column:
    """What a numeric entity stands for; itself if that is no character."""
    hexed = F.lower(F.substring(entity, 3, 1)) == "x"
    code = F.when(hexed, F.conv(F.regexp_extract(entity, "[xX]([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(entity, "([0-9]+)", 1)).cast("long")
    sound = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def mangle_font(fonts: DataFrame, method: str = "idpf") -> DataFrame:
    """fonts (content, uid) with the start of content XORed: 1040 bytes by the SHA-1 of the id, or 1024 by a UUID's bytes. Twice is the identity."""
    @F.pandas_udf("binary")
    def mangled(content: pd.Series, uid: pd.Series) -> pd.Series:
        import hashlib
        import re

        def one(data, key):
            if data is None or key is None:
                return data
            mask, most = (hashlib.sha1(re.sub(r"[ \t\r\n]", "", key).encode()).digest(), 1040) if method == "idpf" else (bytes.fromhex(re.sub(r"[^0-9A-Fa-f]", "", key.removeprefix("urn:uuid:"))), 1024)
            return bytes(b ^ mask[i % len(mask)] for i, b in enumerate(data[:most])) + data[most:]

        return pd.Series([one(c, u) for c, u in zip(content, uid)])

    return fonts.withColumn("content", mangled("content", "uid"))


def signal_checks(docs: DataFrame, signals: str = "expected_signals", text: str = "text") -> DataFrame:
    """docs with ``failed_signals``: of ``no_empty_output``, ``contains:X`` and ``link_ref``, joined by semicolons. Their meaning is inferred."""
    t = F.coalesce(F.col(text), F.lit(""))
    ok = lambda s: F.when(s == "no_empty_output", F.length(F.trim(t)) > 0).when(s.startswith("contains:"), F.contains(t, F.substr(s, F.lit(10)))).when(s == "link_ref", t.rlike(r"\[[^\]]+\]\([^)]+\)")).otherwise(F.lit(False))
    return docs.withColumn("failed_signals", F.filter(tags_of(F.col(signals)), lambda s: ~ok(s)))


def archive_members(files: DataFrame, with_content: bool = False, members: tuple[str, ...] = ()) -> DataFrame:
    """path, member, size, sha256 (and content) of zip files given as (path, content), one file at a time; broken archives give a row with a null member. Named members alone are read."""

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for info in z.infolist():
                            if not members or info.filename in members:
                                data = z.read(info)
                                out.append((path, info.filename, info.file_size, hashlib.sha256(data).hexdigest(), data)[: len(names)])
                except zipfile.BadZipFile:
                    out.append((path, *[None] * (len(names) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(names), kinds(pa))], names)

    names = ["path", "member", "size", "sha256", *["content"] * with_content]
    kinds = lambda pa: (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())[: len(names)]
    return files.select("path", "content").mapInArrow(run, "path string, member string, size long, sha256 string" + ", content binary" * with_content)
