import json

import pytest
from oracle import rows
from pyspark.sql import functions as F

from pagelode.schemas import feature_columns, require_columns, with_default_columns
from pagelode.functions import text as T
from pagelode.sources import epub, readers, writers


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "text, want",
    [
        ('a,b\n1,"ha ""ha"" ha"\n3,4\n', [("1", 'ha "ha" ha'), ("3", "4")]),
        ('a,b\n1,"x,y"\n', [("1", "x,y")]),
        ('a,b\n1,"two\nlines"\n', [("1", "two\nlines")]),
        ("a,b\n1,\n,2\n", [("", "2"), ("1", "")]),
        ('a,b\n1,"{""k"": [1, 2]}"\n', [("1", '{"k": [1, 2]}')]),
        ("a,b\n1,ʤ\n", [("1", "ʤ")]),
        ("a,b\r\n1,2\r\n", [("1", "2")]),
    ],
)
def test_csv(spark, tmp_path, text, want):
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    assert rows(readers.read_csv(spark, str(path))) == want


def test_tsv_headers_and_lineage(spark, tmp_path):
    a, b = put(tmp_path, "a.tsv", "sample_id\tlabel\ns1\theading\n"), put(tmp_path, "b.tsv", "sample_id\tlabel\n")
    df = readers.read_tsv(spark, [a, b], ["sample_id"], lineage="_manifest_path")
    assert [(r.sample_id, r._manifest_path.rsplit("/", 1)[1]) for r in df.collect()] == [("s1", "a.tsv")]
    with pytest.raises(ValueError, match="missing columns: split"):
        readers.read_tsv(spark, b, ["split"])
    with pytest.raises(ValueError, match="header"):
        readers.read_tsv(spark, b, ["label", "sample_id"], exact=True)
    assert feature_columns(df, ["sample_id", "_manifest_path"]) == ["label"]
    assert with_default_columns(df, {"is_x": "boolean"}).first()["is_x"] is False
    assert require_columns(df, ["label"]) is df


def test_ocr_words_keep_quotes(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    path = put(tmp_path, "bullets.tsv", head + '5\t1\t1\t1\t1\t1\t10\t20\t30\t12\t96.5\t"quoted\n')
    r = readers.read_ocr_words(spark, path).first()
    assert (r.image, r.level, r.conf, r.text) == ("bullets", 5, 96.5, '"quoted')


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 7, "file_name": "p.png", "width": 1025, "height": 1025, "page_no": 2, "doc_category": "law"}, {"id": 8, "file_name": "q.png"}],
        "annotations": [{"id": 1, "image_id": 7, "category_id": 3, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 7, "bbox": [0, 0, 1, 1]}],
        "categories": [{"id": 3, "name": "Text"}, {"id": 4}],
    }
    images, notes, categories = readers.read_coco(spark, put(tmp_path, "coco.json", json.dumps(doc)))
    r = readers.coco_regions(images, notes, categories).first()
    assert (r.source_label, r.x, r.y, r.w, r.h, r.page_no) == ("Text", 1.0, 2.0, 3.0, 4.0, 2)
    assert readers.coco_regions(images, notes, categories, most_pages=0).count() == 0
    examples = {r.image_id: r.objects for r in readers.layout_examples(images, notes, "train").collect()}
    assert [o.category_id for o in examples[7]] == [2] and examples[8] == []


def test_broken_json_fails_and_has_a_status(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_json_object(spark, put(tmp_path, "bad.json", "{"), "a int").collect()
    df = spark.createDataFrame([(1, "{}"), (2, "{"), (3, None)], "k int, t string")
    assert [r.json_status for r in readers.with_json_status(df, "t").orderBy("k").collect()] == ["ok", "invalid", "missing"]


def test_xml(spark, tmp_path):
    path = put(tmp_path, "x.xml", "<root><item id='1'>a</item><item id='2'>b</item></root>")
    assert rows(readers.read_xml(spark, path, "item")) == [("a", 1), ("b", 2)]


def test_epub(spark, tmp_path):
    put(tmp_path, "b/META-INF/container.xml", '<?xml version="1.0"?><container xmlns="urn:c"><rootfiles><rootfile full-path="EPUB/package.opf"/></rootfiles></container>')
    put(tmp_path, "b/EPUB/package.opf", '<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title>Tests</dc:title><dc:description>Some</dc:description></metadata><manifest><item id="n" properties="nav" href="nav.xhtml"/></manifest></package>')
    put(tmp_path, "b/EPUB/t.xhtml", '<html xmlns="urn:h"><body><section id="a-1" class="ctest"><h2>One\n  thing</h2></section><section id="a-2" class="otest"><h2>Two</h2></section><section class="ctest"><h2>No id</h2></section></body></html>')
    texts = readers.whole_texts(spark, str(tmp_path / "b"))
    p = readers.epub_packages(texts).first()
    assert (p.package, p.title, p.description, p.nav) == ("EPUB/package.opf", "Tests", "Some", "nav.xhtml")
    tests = readers.epub_tests(texts)
    assert [(r.id, r.kind, r.title) for r in tests.orderBy("pos").collect()] == [("a-1", "REQUIRED", "One thing"), ("a-2", "OPTIONAL", "Two")]
    assert writers.xhtml_form(tests).first()["form"].startswith('<table><tr id="a-1"><td>a-1</td><td class="type REQUIRED">REQUIRED')


def test_epub_collection(spark, tmp_path):
    put(tmp_path, "c/META-INF/container.xml", '<?xml version="1.0"?><container xmlns="urn:c"><rootfiles><rootfile full-path="EPUB/package.opf"/></rootfiles></container>')
    put(tmp_path, "c/EPUB/package.opf", '<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title>Tests</dc:title></metadata><manifest><item id="n" properties="nav" href="nav.xhtml"/></manifest></package>')
    nav = '<html xmlns="urn:h"><body><ol><li class="category"><a href="t.xhtml#intro">Cat &amp; A</a><ol><li class="subcategory"><span>Sub</span><ol><li><a href="t.xhtml#a-1">One\n thing</a></li></ol></li><li><a href="t.xhtml#a-2">Two</a></li><li><a href="t.xhtml#gone">x</a></li><li><a href="t.xhtml">y</a></li></ol></li></ol></body></html>'
    put(tmp_path, "c/EPUB/nav.xhtml", nav)
    put(tmp_path, "c/EPUB/t.xhtml", '<html xmlns="urn:h"><body><section id="intro"/><section id="a-1" class="ctest"><p class="desc">Long <b>&lt;one&gt;</b></p></section><section id="a-2" class="otest"><p class="desc">Long two</p></section></body></html>')
    put(tmp_path, "c/EPUB/broken.xhtml", "<html><p></html>")
    texts = readers.whole_texts(spark, str(tmp_path / "c"))
    tests = epub.collection(texts)
    assert rows(tests.select("id", "kind", "category", "subcategory", "short", "long", "title")) == [
        ("a-1", "REQUIRED", "Cat & A", "Sub", "One thing", "Long <one>", "Tests"), ("a-2", "OPTIONAL", "Cat & A", None, "Two", "Long two", "Tests")]
    form = writers.xhtml_form(tests, "root").first()["form"]
    assert form.count("Cat &amp; A") == 1 and form.count(">Sub<") == 1 and "Long &lt;one&gt;" in form and form.index("Cat") < form.index("Sub") < form.index("a-1")
    assert [r.path.rsplit("/", 1)[1] for r in epub.elements(texts.where("path like '%.xhtml'")).where("error is not null").collect()] == ["broken.xhtml"]


def test_uris_streams_and_dates(spark):
    import datetime as dt

    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    d = one(T.data_uri(F.lit("data:text/plain;charset=utf-8;base64,SGVsbG8sIFdvcmxkIQ==")))
    assert (d.mime, d.attributes, d.charset, d.text, bytes(d.bytes)) == ("text/plain", {"charset": "utf-8"}, "utf-8", "Hello, World!", b"Hello, World!")
    d = one(T.data_uri(F.lit("data:base64,SGk=")))
    assert (d.mime, d.attributes, d.text) == (None, {}, "Hi")
    d = one(T.data_uri(F.lit("data:,Hello%2C%20World%21")))
    assert (d.mime, d.is_base64, d.text) == (None, False, "Hello, World!") and one(T.data_uri(F.lit("http://x"))) is None
    for uri, want in (("file:///path/to/f.txt", (None, "/path/to/f.txt")), ("file:/p/f.txt", (None, "/p/f.txt")), ("file://localhost/p/f%20x.txt?q=1", ("localhost", "/p/f x.txt")), ("file:///p/f#a", (None, "/p/f"))):
        assert tuple(one(T.file_uri(F.lit(uri)))) == want
    for name, data, want in (
        ("a.docx", b"PK\x03\x04rest", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx", None)), ("a.bin", b"%PDF-1.7", ("application/pdf", ".pdf", None)), ("b.jpg", b"\xff\xd8\xff\xe0", ("image/jpeg", ".jpg", None)),
        ("c.csv", "é,1".encode(), ("text/csv", ".csv", "utf-8")), ("d.html", b"<html></html>", ("text/html", ".html", "ascii")), ("e", b"<?xml version='1.0'?>", ("text/xml", None, "ascii")), ("f.dat", b"\x00\x01", (None, ".dat", None)),
    ):
        assert tuple(one(T.stream_info(F.lit(name), F.lit(data)))) == want, name
    at = F.lit(dt.datetime(2013, 1, 23, 12, 30, 5, 123000))
    for code, want in (("dd/mm/yy", "23/01/13"), ("dd m yy", "23 1 13"), ("d mmm yy", "23 Jan 13"), ("d mmmm yyy", "23 January 2013"), ("dd/mm/yy hh:mm:ss.000", "23/01/13 12:30:05.123"), ("hh:mm", "12:30"), ("hh:mm:ss", "12:30:05")):
        assert one(T.date_text(at, code)) == want


def test_files_front_matter_and_markers(spark, tmp_path):
    put(tmp_path, "d/a.md", "---\ntitle: 'A b'\nlist:\n  - x\n---\nbody\n")
    put(tmp_path, "d/b.TXT", "one\nTraceback here\n")
    listing = readers.files(spark, str(tmp_path / "d"))
    assert rows(listing.select("stem", "extension", "size")) == [("a", "md", 38), ("b", "txt", 19)]
    assert rows(readers.file_hashes(spark, str(tmp_path / "d"), "*.TXT").select("md5")) != []
    texts = readers.whole_texts(spark, str(tmp_path / "d"))
    assert [(r.key, r.value) for r in readers.front_matter(texts).collect()] == [("title", "A b")]
    assert sorted(r.found for r in readers.marked_lines(texts, "Traceback").collect()) == [False, True]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\tz', 1), ("b", "line\nfeed", 2)], "k string, t string, n int")
    writers.write_tsv(df, str(tmp_path / "t"), ["t", "k"], single=True)
    back = readers.read_tsv(spark, str(tmp_path / "t"), ["t", "k"], exact=True)
    assert rows(back) == [("line\nfeed", "b"), ('x "y"\tz', "a")]
    for stamp in ("2024-01-01", "2024-02-01"):
        writers.write_versioned(df.withColumn("n", F.col("n") + len(stamp)), str(tmp_path / "v"), stamp)
    assert {str(r.check_ts) for r in writers.latest(spark.read.parquet(str(tmp_path / "v")), ["k"]).collect()} == {"2024-02-01"}
    writers.append_log(df, str(tmp_path / "l"))
    writers.append_log(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 4
    writers.write_by(df, str(tmp_path / "p"), "k")
    assert sorted(p.name for p in (tmp_path / "p").glob("k=*")) == ["k=a", "k=b"]
    assert json.loads(writers.as_json(df).first()["json"])["k"] == "a"
    scores = spark.createDataFrame([("heading", 3, 1.0, 0.5, 0.6667)], "label string, support int, precision double, recall double, f1 double")
    top = spark.createDataFrame([("a", "b", 2, 1)], "gold string, pred string, n int, rank int")
    assert "| heading | 3 | 1.0000 |" in writers.error_report(scores, top)
