"""The tests of EPUB collections: navigation entries, what they name, and their descriptions.

Documents are given as (path, text). Each is parsed as XML in one Arrow pass; one
that is malformed gives a row with an error and no elements.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.sources.readers import epub_packages


def _parsed(texts: DataFrame, schema: str, read) -> DataFrame:
    """read(path, root element) yields tuples of schema; a parse error yields (path, nulls, error)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        from xml.etree import ElementTree

        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            out = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                try:
                    out += [(path, *row, None) for row in read(ElementTree.fromstring((text or "").encode()))]
                except ElementTree.ParseError as e:
                    out.append((path, *[None] * (len(names) - 2), str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    return texts.select("path", "text").mapInArrow(run, schema)


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split())


def elements(texts: DataFrame) -> DataFrame:
    """path, id, class, tag, text, description (of the first part of class ``desc``), error: all elements that have an id, by any namespace."""

    def read(root) -> Iterator[tuple]:
        for node in root.iter():
            if isinstance(node.tag, str) and node.get("id") is not None:
                about = next((x for x in node.iter() if x is not node and x.get("class") == "desc"), None)
                yield node.get("id"), node.get("class"), node.tag.rpartition("}")[2], _text(node), None if about is None else _text(about)

    return _parsed(texts, "path string, id string, class string, tag string, text string, description string, error string", read)


def navigation(texts: DataFrame) -> DataFrame:
    """path, pos, href, label, category, subcategory, error: the links of list items in order, with the headings of the items around them."""

    def read(root) -> Iterator[tuple]:
        pos = 0

        def walk(node, category: str, subcategory: str | None, in_item: bool) -> Iterator[tuple]:
            nonlocal pos
            name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
            if name == "a" and in_item and node.get("href") is not None:
                yield pos, node.get("href"), _text(node), category, subcategory
                pos += 1
            if name == "li":
                own = lambda tag: next((x for x in node if isinstance(x.tag, str) and x.tag.rpartition("}")[2] == tag), None)
                if node.get("class") == "category" and own("a") is not None:
                    category = _text(own("a"))
                if node.get("class") == "subcategory" and own("span") is not None:
                    subcategory = _text(own("span"))
            for child in node:
                yield from walk(child, category, subcategory, name == "li")

        yield from walk(root, "", None, False)

    return _parsed(texts, "path string, pos int, href string, label string, category string, subcategory string, error string", read)


def collection(texts: DataFrame) -> DataFrame:
    """root, title, pos, id, kind (REQUIRED for ctest, OPTIONAL for otest), category, subcategory, short, long: tests of unpacked EPUBs, found through their navigation."""
    packages = epub_packages(texts)
    folder = F.regexp_replace(F.concat("root", F.lit("/"), "package"), r"[^/]*$", "")
    navs = packages.select("root", "title", F.concat(folder, "nav").alias("path"))
    links = navs.join(navigation(navs.select("path").join(texts, "path")), "path").where("href is not null and instr(href, '#') > 0")
    file, base = F.regexp_extract("href", "^([^#]*)#", 1), F.regexp_replace("path", r"[^/]*$", "")
    named = links.select("root", "title", "pos", "category", "subcategory", F.col("label").alias("short"), F.when(file == "", F.col("path")).otherwise(F.concat(base, file)).alias("_path"), F.regexp_extract("href", "#(.*)$", 1).alias("_id"))
    marked = elements(texts.where(F.col("path").rlike(r"\.x?html$"))).where(F.col("class").isin("ctest", "otest"))
    found = named.join(marked, (F.col("_path") == F.col("path")) & (F.col("_id") == F.col("id")))
    return found.select("root", "title", "pos", "id", F.when(F.col("class") == "ctest", "REQUIRED").otherwise("OPTIONAL").alias("kind"), "category", "subcategory", "short", F.col("description").alias("long"))
