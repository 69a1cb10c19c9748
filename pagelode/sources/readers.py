"""Readers: delimited text, JSON, COCO annotations, XML, EPUB, OCR words, files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.schemas import require_columns


def read_delimited(spark: SparkSession, paths: str | Sequence[str], separator: str = "\t", quoted: bool = True, lineage: str | None = None) -> DataFrame:
    """All-string rows with '' for empty cells. Quoted cells may hold separators, quotes and line feeds; ``lineage`` names a column for the file's path."""
    read = spark.read.option("header", True).option("sep", separator).option("multiLine", quoted).option("emptyValue", "").option("nullValue", "\0")
    read = read.option("quote", '"').option("escape", '"') if quoted else read.option("quote", "")
    df = read.csv(paths if isinstance(paths, str) else list(paths)).na.fill("")
    return df.withColumn(lineage, F.col("_metadata.file_path")) if lineage else df


def read_tsv(spark: SparkSession, paths: str | Sequence[str], required: Iterable[str] = (), exact: bool = False, **how) -> DataFrame:
    return require_columns(read_delimited(spark, paths, **how), required, exact)


def read_csv(spark: SparkSession, paths: str | Sequence[str], **how) -> DataFrame:
    return read_delimited(spark, paths, ",", **how)


def read_ocr_words(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """OCR word rows with numeric columns; quotes are ordinary characters. ``image`` is the file's name without suffix."""
    df = read_delimited(spark, paths, quoted=False, lineage="_path")
    numbers = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")
    return df.withColumns({c: F.col(c).cast("int") for c in numbers}).withColumn("conf", F.col("conf").cast("double")).withColumn("image", F.regexp_extract("_path", r"([^/]+)\.[^./]*$", 1)).drop("_path")


def read_json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; malformed files fail."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def with_json_status(rows: DataFrame, text: str) -> DataFrame:
    """rows with ``json_status``: ok, missing or invalid."""
    return rows.withColumn("json_status", F.when(F.col(text).isNull(), "missing").when(F.expr(f"try_parse_json(`{text}`)").isNull(), "invalid").otherwise("ok"))


COCO = (
    "images array<struct<id:long,file_name:string,width:double,height:double,page_no:int,doc_category:string,doc_name:string>>,"
    "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>>>,categories array<struct<id:long,name:string>>"
)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images with position, annotations with position, categories) of COCO JSON; annotations without an integer image or category are left out."""
    df = read_json_object(spark, path, COCO)
    images = df.select(F.posexplode("images").alias("image_pos", "r")).select("image_pos", "r.*").where("id is not null")
    notes = df.select(F.posexplode("annotations").alias("annotation_pos", "r")).select("annotation_pos", "r.*").where("image_id is not null and category_id is not null")
    return images, notes, df.select(F.inline("categories")).where("id is not null and name is not null")


def coco_regions(images: DataFrame, notes: DataFrame, categories: DataFrame, most_pages: int | None = None) -> DataFrame:
    """Annotations with page and category name, x, y, w, h; pages by position up to ``most_pages``."""
    pages = images if most_pages is None else images.where(F.col("image_pos") < most_pages)
    p = pages.select(F.col("id").alias("image_id"), "image_pos", "file_name", "page_no", "doc_category")
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("source_label"))
    boxes = {k: F.get("bbox", F.lit(i)) for i, k in enumerate("xywh")}
    return notes.join(p, "image_id").join(c, "category_id", "left").withColumns(boxes)


def layout_examples(images: DataFrame, notes: DataFrame, split: str) -> DataFrame:
    """split, image_id, objects (category_id less 1 unless -1, bbox), in annotation order."""
    at = notes.withColumn("category", F.when(F.col("category_id") == -1, -1).otherwise(F.col("category_id") - 1))
    grouped = at.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("annotation_pos", "category", "bbox"))), lambda x: F.struct(x["category"].alias("category_id"), x["bbox"].alias("bbox"))).alias("objects"))
    return images.select(F.lit(split).alias("split"), F.col("id").alias("image_id"), "image_pos").join(grouped, "image_id", "left").withColumn("objects", F.coalesce("objects", F.array().cast(grouped.schema["objects"].dataType)))


def read_xml(spark: SparkSession, path: str, row: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).load(path)


def files(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path, name, stem, extension, size, modified of files; contents are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    df = (read.option("pathGlobFilter", pattern) if pattern else read).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_hashes(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, size, sha256, md5."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (read.option("pathGlobFilter", pattern) if pattern else read).load(folder)
    return df.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def whole_texts(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, text."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _bare(xml: Column) -> Column:
    """XML without namespaces, so that XPath names are plain."""
    no_decl = F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    plain = F.regexp_replace(no_decl, r"\s+xmlns(:[\w.-]+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(</?)[\w.-]+:", "$1"), r"\s[\w.-]+:([\w.-]+\s*=)", " $1")


def epub_packages(texts: DataFrame) -> DataFrame:
    """root, package, title, description, nav of unpacked EPUBs given as (path, text): container, then its package document, then the nav item."""
    root = F.regexp_extract("path", r"^(.*)/META-INF/container\.xml$", 1)
    box = texts.where(F.col("path").endswith("/META-INF/container.xml")).select(root.alias("root"), F.xpath_string(_bare(F.col("text")), F.lit("//rootfile/@full-path")).alias("package"))
    opf = box.withColumn("path", F.concat("root", F.lit("/"), "package")).join(texts, "path")
    x = _bare(F.col("text"))
    nav = F.xpath_string(x, F.lit("//manifest/item[contains(concat(' ', @properties, ' '), ' nav ')]/@href"))
    return opf.select("root", "package", F.xpath_string(x, F.lit("//metadata/title")).alias("title"), F.xpath_string(x, F.lit("//metadata/description")).alias("description"), nav.alias("nav"))


def epub_tests(texts: DataFrame) -> DataFrame:
    """path, id, kind (REQUIRED for ctest, OPTIONAL for otest), title: the marked sections of XHTML documents, in order."""
    x = _bare(F.col("text"))
    marked = "//section[@id and (@class='ctest' or @class='otest')]"
    parts = F.arrays_zip(F.xpath(x, F.lit(f"{marked}/@id")).alias("id"), F.xpath(x, F.lit(f"{marked}/@class")).alias("class"), F.xpath(x, F.lit(f"{marked}/*[1]/text()")).alias("title"))
    rows = texts.where(F.col("path").rlike(r"\.x?html$")).select("path", F.posexplode(parts).alias("pos", "t"))
    return rows.select("path", "pos", F.col("t.id").alias("id"), F.when(F.col("t.class") == "ctest", "REQUIRED").otherwise("OPTIONAL").alias("kind"), F.trim(F.regexp_replace("t.title", r"\s+", " ")).alias("title"))


def front_matter(texts: DataFrame) -> DataFrame:
    """path, key, value of the scalar lines of a YAML front matter; nested values are left to a YAML reader."""
    head = F.regexp_extract("text", r"(?s)\A---\s*\n(.*?)\n(---|\.\.\.)\s*(\n|\z)", 1)
    line = F.explode(F.split(head, "\n"))
    rows = texts.select("path", line.alias("line")).where(F.col("line").rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    return rows.select("path", F.regexp_extract("line", r"^([\w-]+):", 1).alias("key"), F.regexp_replace(F.regexp_extract("line", r"^[\w-]+:\s*(.*?)\s*$", 1), r"^['\"](.*)['\"]$", "$1").alias("value"))


def marked_lines(texts: DataFrame, marker: str) -> DataFrame:
    """path, found: whether any line holds the marker."""
    return texts.select("path", F.contains("text", F.lit(marker)).alias("found"))
