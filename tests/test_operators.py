import datetime as dt
import io
import json
import random
import zipfile

import pytest
import oracle
from oracle import rows
from pyspark.sql import functions as F

from pagelode.functions import text as T
from pagelode.operators import check_results, documents, layout, manifests, metrics, models, relations
from pagelode.plans import block_rules, gate_oracle
from pagelode.schemas import BLOCK_LABELS, LEGACY_LABELS
from pagelode.streaming import streams


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("value, want", [("[1,2,3,4]", (1, 2, 3, 4)), ('{"x0":1,"y0":2,"x1":4,"y1":8}', (1, 2, 3, 6)), ('{"left":1,"top":2,"width":3,"height":4}', (1, 2, 3, 4)), ('{"x":"a","y":2,"w":3,"h":4}', None), ("[1,2]", None)])
def test_boxes(spark, value, want):
    got = one(spark, b=T.bbox_of(F.lit(value))).b
    assert (tuple(got) if got else None) == want


def test_small_functions(spark):
    r = one(
        spark, z=T.number_of(F.lit("")), s=T.sigmoid(F.lit(-800.0)), b=T.bucket(F.lit(0.16), [0.08, 0.16]), m=T.list_marker_type(F.lit(" (3) x")), n=T.occurrences(F.lit("aaaa"), F.lit("aa")),
        l=T.ocr_language(F.lit("zh-CN")), p=T.split_plan(F.lit(10)), t=T.tags_of(F.lit("a; b;;")), u=T.data_uri(F.lit("data:text/plain;base64,SGk=")), v=T.data_uri(F.lit("data:,a%20b")),
        k=T.stream_info(F.lit("x"), F.lit(b"%PDF-1.7"))["mimetype"], q=T.safe_ratio(F.lit(1), F.lit(0)), f=T.flag_of(F.lit("0.5")), w=metrics.normalised(F.lit("PageNumber"), LEGACY_LABELS, BLOCK_LABELS), x=metrics.normalised(F.lit("CrossPageMerge"), LEGACY_LABELS, BLOCK_LABELS),
    )
    assert (r.z, r.s, r.b, r.m, r.n, r.l, tuple(r.p), r.t) == (0.0, 0.0, 1, 2, 2, "chi_sim", (7, 2, 2), ["a", "b"])
    assert (r.u.mime, r.u.is_base64, r.u.text, r.v.text, r.k, r.q, r.f, r.w, r.x) == ("text/plain", True, "Hi", "a b", "application/pdf", 0.0, True, "footer_header_noise", None)


@pytest.mark.parametrize("text, flags", [("1. First", {"starts_bullet", "starts_numbered", "section_number_prefix"}), ("See Figure 2:", {"contains_figure_hint", "ends_colon"}), ("mail a.b@c.org", {"contains_email"}), ("a) b", {"starts_numbered", "starts_with_alpha_marker"})])
def test_text_flags(spark, text, flags):
    found = T.text_features(F.lit(text))
    r = one(spark, **{n: found[n] for n in T.FLAGS})
    assert {n for n in T.FLAGS if r[n]} == flags


BASE = {"text": "Some words", "word_count": 2.0}


def decide(spark, **features):
    row = BASE | features
    kinds = {c: "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) or c == "text" else "double" for c, v in row.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return block_rules.predicted(df).first()


def test_rules(spark):
    r = decide(spark, is_heading_kind=True)
    assert (r.rule_heading, r.rule_paragraph, r.rule_label) == (0.96, 0.52, "heading")
    r = decide(spark, is_heading_kind=True, contains_currency=True)
    assert (r.rule_heading, r.rule_form_row, r.rule_label) == (0.28, 0.74, "form_row")
    r = decide(spark, looks_like_bullet=True, digit_ratio=0.6)
    assert (r.rule_list_item, r.rule_footer_header_noise) == (0.16, 0.58)
    assert decide(spark, near_dest_annotation_distance=2.0).rule_link_text == 0.96 and decide(spark).rule_link_text == 0.12  # an absent distance is not 0
    assert decide(spark, toc_like_anchor_signal=True, link_target_named=True).rule_link_text == 0.95
    assert decide(spark, text=None, looks_like_list_marker_token=True).rule_list_item == 0.82
    assert decide(spark, looks_like_bullet=True, looks_like_separator=None).rule_list_item == 0.72
    assert decide(spark, text="\n1 Intro\u3000", top_zone_candidate=True).rule_heading == 0.82
    assert decide(spark, is_heading_kind="0.5", contains_time="", word_count="2").rule_heading == 0.96
    r = decide(spark, model_heading=0.9, model_paragraph=0.5, model_caption=0.5)
    assert (r.model_label, r.model_second, r.model_margin) == ("heading", "caption", pytest.approx(0.4))
    r = decide(spark, identifier_like_signal=True)
    assert (r.rule_keep_as_text, r.rule_paragraph, r.context_keep_as_text) == (0.90, 0.48, pytest.approx(0.20))


def test_gate(spark):
    r = decide(spark, is_heading_kind=True, has_terminal_period=True, model_paragraph=1.0, model_heading=0.1, contains_currency=False)
    assert (r.rule_label, r.weighted_label, r.blocked_reason, r.gated_label) == ("heading", "paragraph", None, "paragraph")
    r = decide(spark, is_table_cell_candidate=True, model_paragraph=1.0, same_paragraph_candidate=True, has_terminal_period=True)
    assert (r.rule_label, r.weighted_label, r.blocked_reason, r.gated_label) == ("table_like", "paragraph", "table_geometry", "table_like")
    r = decide(spark, is_table_cell_candidate=True, contains_currency=True, model_form_row=1.0)
    assert (r.rule_label, r.weighted_label, r.hard_constraints, r.blocked_reason, r.gated_label) == ("table_like", "form_row", "table_geometry", "table_geometry", "table_like")
    r = decide(spark)
    assert (r.model_confidence, r.model_label, r.model_second) == (0.0, max(BLOCK_LABELS), sorted(BLOCK_LABELS)[1])  # the last of equals; the second by name


@pytest.mark.parametrize("preset", ["conservative", "tuned"])
def test_gate_equals_its_sql_on_random_rows(spark, tmp_path, preset):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    assert {*gate_oracle.BOOLEANS, *gate_oracle.FLAG_CELLS} == set(block_rules.FLAGS)
    assert {*gate_oracle.DISTANCES, *gate_oracle.DISTANCE_CELLS} == set(block_rules.DISTANCES)
    assert {*gate_oracle.NUMBERS, *gate_oracle.NUMBER_CELLS} == {*block_rules.NUMBERS, *[f"model_{x}" for x in BLOCK_LABELS]}
    rng, n = random.Random(11), 4000
    texts = [None, "", " \t", "\n1 Intro", "2.3 \u3000Scope", "第三章绪论", "\xa0• ‣ ", "1. the words go on and end here.", "Go to page 4", "(02) 555 1234", "a@b.org", "Open it", "plain words"]
    share = [rng.choice([0.03, 0.1, 0.25]) for _ in range(n)]
    columns = {"doc_id": list(range(n)), "line_no": [0] * n, "text": [rng.choice(texts) for _ in range(n)]}
    for c in gate_oracle.BOOLEANS:
        columns[c] = [None if rng.random() < 0.05 else rng.random() < share[i] for i in range(n)]
    for c in gate_oracle.FLAG_CELLS:
        columns[c] = [rng.choice(["1", "0.5", "2"]) if rng.random() < share[i] else rng.choice([None, "", "0", "0.49"]) for i in range(n)]
    numbers = {"word_count": [0, 1, 2, 3, 4, 5, 6, 7, 8, 16, 20], "page_block_count": [1, 8, 9, 30, 40, 50], "line_count": [0, 1, 2], "relative_font_size": [0.9, 0.95, 1.0, 1.02, 1.12, 1.15, 1.3]}
    for c in gate_oracle.NUMBERS:
        columns[c] = [None if rng.random() < 0.05 else float(rng.choice(numbers[c])) if c in numbers else rng.choice([0.0, 0.3, 0.34, 0.35, 0.45, 0.5, 0.55, 0.6, 0.75, 0.85, 0.9, 1.0, rng.random()]) for _ in range(n)]
    columns["digit_ratio"] = [rng.choice([None, "", "0.5", "0.9", "0.1"]) for _ in range(n)]
    for c in gate_oracle.DISTANCES:
        columns[c] = [rng.choice([None, 0.0, 2.0, 4.0, 4.5, 8.0]) for _ in range(n)]
    columns["near_dest_annotation_distance"] = [rng.choice([None, "", "2", "2.5", "8", "9"]) for _ in range(n)]
    path = str(tmp_path / "rows.parquet")
    pq.write_table(pa.table(columns), path)
    shown = ["doc_id", *[f"{k}_{x}" for k in ("rule", "context", "weighted", "naive") for x in BLOCK_LABELS], *[f"{s}_label" for s in ("rule", "model", "weighted", "naive", "gated")],
             "model_second", "weighted_second", "weighted_margin", "model_margin", "model_confidence", "blocked_reason"]
    got = block_rules.predicted(spark.read.parquet(path), preset)
    assert len({r.gated_label for r in got.select("gated_label").distinct().collect()}) == len(BLOCK_LABELS)
    con = duckdb.connect()
    oracle.same(got.select(*shown), f"SELECT {', '.join(shown)} FROM ({gate_oracle.gate_sql(repr(path), preset)})", con)


def test_cells_of_nodes_and_their_children(spark):
    payload = json.dumps({"text": "parent", "bbox": [0, 0, 9, 9], "parts": [{"token": "child", "x": 1, "y": 1, "w": 2, "h": 2}, {"text": " ", "bbox": [1, 1, 1, 1]}, [{"value": "deep", "box": {"x0": 1, "y0": 2, "x1": 3, "y1": 5}}]]})
    df = spark.createDataFrame([(1, payload), (2, "{"), (3, None)], "page_id long, payload string")
    assert rows(layout.text_cells(df)) == [(1, "child", 1.0, 1.0, 2.0, 2.0), (1, "deep", 1.0, 2.0, 2.0, 3.0), (1, "parent", 0.0, 0.0, 9.0, 9.0)]


def test_neighbours_group_by_page_number_and_count_on_the_same_page_only(spark):
    data = [("p1", 1, 0, 0.0, 10.0, 50.0, 5.0, "a."), ("p2", 1, 1, 0.0, 20.0, 50.0, 5.0, "b"), ("p1", 1, 2, 0.0, 30.0, 50.0, 5.0, "- c")]
    df = spark.createDataFrame(data, "page_id string, page_no int, seq int, x double, y double, w double, h double, text string")
    by_no = {r.seq: r for r in layout.neighbours(df, group="page_no").collect()}
    assert by_no[0].next_gap == 1.0 and not by_no[0].next_starts_marker
    by_page = {r.seq: r for r in layout.neighbours(df).collect()}
    assert by_page[0].next_starts_marker and by_page[2].prev_ends_period and by_page[0].next_gap == pytest.approx(15 / 1025, abs=1e-6)


def test_diverse_sample_prefers_rare_labels(spark):
    data = [("train", i, "law", ["Text"] + (["Table"] if i == 5 else []), 3) for i in range(8)] + [("train", 9, "law", [], 50)]
    df = spark.createDataFrame(data, "split string, page_id long, category string, labels array<string>, n_annotations int")
    got = [r.page_id for r in layout.diverse_sample(df, {"train": 3}).orderBy("step").collect()]
    assert got[0] == 5 and 9 not in got and len(got) == 3


def test_micro_and_macro(spark):
    counts = metrics.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "gold string, pred string"))
    assert tuple(metrics.micro(counts).first())[:3] == (2, 1, 2)
    assert metrics.macro(counts, ["a", "b", "z"]).first()["macro_f1"] == pytest.approx(0.4445, abs=1e-3)


def test_blank_ids_and_first_wins(spark):
    df = spark.createDataFrame([("f", "A", 0), ("f", "", 1), ("f", "A", 2), ("f", None, 3)], "file string, ID string, seq int")
    got = relations.first_wins(relations.with_blank_ids(df, "file", "ID", "seq"), ["file", "ID"], "seq")
    assert rows(got) == [("f", "A", 0), ("f", "BlankID_1", 1), ("f", "BlankID_2", 3)]


def test_fragments_and_paths(spark):
    links = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "c")], "doc string, fragment string")
    elements = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "b")], "doc string, id string")
    assert [r.status for r in relations.resolve_fragments(links, elements).orderBy("fragment").collect()] == ["resolved", "ambiguous", "missing"]
    candidates = spark.createDataFrame([("k", "x/1", 0), ("k", "y/1", 1), ("k", "z/1", 2)], "key string, path string, rank int")
    assert rows(relations.first_existing(candidates, spark.createDataFrame([("z/1",), ("y/1",)], "path string"), "key")) == [("k", "y/1")]


def result(**parts):
    return json.dumps({"publication": {"title": "t"}, "items": [], "messages": []} | parts)


def test_check_diff(spark):
    item = lambda i, s, refs=(): {"id": i, "isSpineItem": True, "spineIndex": s, "checkSum": f"c{s}", "fileName": f"{i}.xhtml", "referencedItems": list(refs)}
    message = {"ID": "M1", "severity": "ERROR", "message": "m", "additionalLocations": 3, "locations": [{"fileName": None, "line": 1, "column": 2}, {"fileName": "f", "line": 1, "column": 2}]}
    blank = {"ID": "", "severity": "WARNING", "message": "w", "locations": []}
    old = result(publication={"title": "t", "nSpines": 1}, items=[item("a", 9), item("a", 0, "xy"), item("c", 5)], messages=[blank, message | {"severity": "USAGE"}])
    new = result(publication={"title": "t", "nSpines": 2}, items=[item("a", 1, "yz"), item("n", 2), item("c", 5)], messages=[message, message | {"message": "a second one"}, blank, blank])
    old, new = (spark.createDataFrame([("b", x), ("same", result(publication={"nSpines": 3}, messages=[blank])), (gone, None)], "file string, result string") for x, gone in ((old, "old"), (new, "new")))
    got = {(r.file, r.level): r.code for r in check_results.compare(old, new).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "b"} == {
        "Pub": "Pub-xA-xR-C1", "Spine": "Spine-N2-U1-A1-xR-OC1-CC1", "Mani": "Mani-A1-xR-C1", "Refs": "Refs-A1-R1-xC", "Mess": "Mess-A1-xR-C1", "Loc": "Loc=="}
    assert {k[1]: v for k, v in got.items() if k[0] == "same"} == {"Pub": "Pub==", "Spine": "Spine==-N3", "Mani": "Mani==", "Refs": "Refs==", "Mess": "Mess=!xA-xR-xC", "Loc": "Loc=="}
    assert got["old", "Spine"] == got["new", "Spine"] == "Spine==-NNone"
    told = {(r.level, r.id, r.property): (r.status, r.old_value, r.new_value) for r in check_results.differences(old, new).where("file = 'b' and status <> 'unchanged'").collect()}
    assert told["ItemProperty", "a", "checkSum"] == ("changed", "a.xhtml", "a.xhtml") and told["Order", "a", ""] == ("changed", "0", "1")
    assert told["MessageProperty", "M1", "severity"] == ("changed", "USAGE", "ERROR") and told["Mess", "BlankID_2", ""][0] == "added" and told["Refs", "a", "z"][0] == "added"
    assert {r.file: r.n_errors for r in check_results.outcome(new).collect()} == {"b": 4, "same": 0, "new": 0}
    assert [r.place for r in check_results.locations(check_results.messages(new)).orderBy("place").collect()] == ["M1HasNullFileNameLoc-1-2", "f-1-2"]
    assert {r.file: r.is_unchanged for r in check_results.unchanged(check_results.compare(old, new)).collect()} == {"b": False, "same": True, "old": True, "new": True}
    runs = [("a.epub", False, False, None, False, 0), ("b.EPUB", False, False, "x", True, 0), ("c", True, True, None, None, 2), ("d.txt", False, False, None, None, 0), ("9780000000001x.epub", False, False, "not_found", None, None)]
    runs = spark.createDataFrame(runs, "file string, is_dir boolean, has_mimetype boolean, error string, timed_out boolean, n_errors int")
    assert {r.file[0]: (r.status, r.name) for r in check_results.check_status(runs).withColumn("name", check_results.report_name(F.col("file"), True)).collect()} == {
        "a": ("clean", "a.epubCheck.json"), "b": ("timeout", "b.EPUBCheck.json"), "c": ("severe", "cCheck.json"), "d": ("skipped", "d.txtCheck.json"), "9": ("not_found", "9780000000001.ePubCheck.json")}


def test_html_characters(spark):
    html = "<p>a&nbsp;&lt;b&gt; &amp;lt; &#233;&#xE9;&#x1F600; &#0;&#xD800; &hellip;&mdash;&apos;</p><!-- x --><style>p{}</style>"
    assert one(spark, t=documents.html_text(F.lit(html))).t == "a <b> &lt; éé\U0001f600 &#0;&#xD800; …—'"


def test_markdown_and_numbering(spark):
    text = "| a | b |\n| --- | --- |\n| 1 | 2 |\ntext\n| x |\n"
    got = documents.table_checks(documents.table_lines(documents.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))))
    assert [(r.n_rows, r.n_cols, r.reason) for r in got.orderBy("table_no").collect()] == [(2, 2, "ok"), (1, 1, "too_few_rows")]
    assert one(spark, n=documents.isolated_numbers(F.lit(".1\n  .22 \nx .3\n.4 y\n.5"))).n == 3
    merged = documents.merge_numbering(documents.lines(spark.createDataFrame([(1, ".1\n\nThe intent\n.2\nNext\n.3")], "doc_id long, text string")))
    assert [r.line for r in merged.orderBy("line_no").collect()] == [".1 The intent", "", ".2 Next", ".3"]


def test_golden_order_and_signals(spark):
    a = spark.createDataFrame([(1, "x\ny\n|z|")], "k int, text string")
    assert documents.golden(a, spark.createDataFrame([(1, "x\n|y|")], "k int, text string"), "k").first()["passed"]
    assert one(spark, a=documents.in_order(F.lit("one two three"), ["one", "three"]), b=documents.in_order(F.lit("one two"), ["two", "one"])) == (True, False)
    df = spark.createDataFrame([("no_empty_output;contains:abc;link_ref", "xabc")], "expected_signals string, text string")
    assert documents.signal_checks(df).first()["failed_signals"] == ["link_ref"]


def test_html(spark):
    html = "<html><script>var t='</p>';</script><style>p{}</style><!-- ad --><p>A&amp;B <b>c</b>&nbsp;</p>" + "<div>" * 500 + "deep" + "</div>" * 500
    assert one(spark, t=documents.html_text(F.lit(html))).t == "A&B c deep"


def test_preview(spark):
    data = [("pdf", "x", "", ""), ("png", "x" * 160, "", ""), ("png", "x", "", ""), ("png", " ", "negative", ""), ("png", "", "", "no_text"), ("png", "", "", ""), ("exe", "x", "", ""), ("png", None, "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, extension string, text string, scenario string, tags string").withColumn("language", F.lit("en"))
    assert [r.status for r in documents.preview_status(df).orderBy("i").collect()] == ["skipped", "pass", "weak", "pass", "pass", "weak", "skipped", "not_run"]


def test_fonts_and_archives(spark):
    data = [(bytes(range(256)) * 8, "urn:uuid:12345678-1234-1234-1234-123456789abc"), (b"", "x"), (None, "x")]
    df = spark.createDataFrame(data, "content binary, uid string")
    for method in ("idpf", "adobe"):
        use = df.limit(1) if method == "adobe" else df
        once = documents.mangle_font(use, method)
        assert once.first()["content"] != use.first()["content"]
        assert [r.content for r in documents.mangle_font(once, method).collect()] == [r.content for r in use.collect()]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    files = spark.createDataFrame([("ok.zip", buffer.getvalue()), ("bad.zip", b"no")], "path string, content binary")
    assert [(r.path, r.member, r.size) for r in documents.archive_members(files).orderBy("path").collect()] == [("bad.zip", None, None), ("ok.zip", "a.txt", 5)]


def test_ocr_preview(spark):
    words = [("i", 5, 1, 1, 1, 1, 1, 0, 90.0, "Title"), ("i", 5, 1, 2, 1, 1, 1, 0, 80.0, "Body"), ("i", 5, 1, 2, 1, 1, 2, 60, 70.0, "text."), ("i", 5, 1, 3, 1, 1, 1, 0, 50.0, "Page"), ("i", 5, 1, 3, 1, 1, 2, 30, 50.0, "1"), ("i", 4, 1, 3, 1, 1, 0, 0, -1.0, "")]
    df = spark.createDataFrame(words, "image string, level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, conf double, text string").withColumns({"top": F.lit(0), "width": F.lit(20), "height": F.lit(9)})
    blocks = documents.ocr_blocks(documents.ocr_lines(df))
    assert documents.markdown_preview(blocks).first()["markdown"] == "# Title\n\nBody text."
    assert [(r.column_no, r.text) for r in documents.split_columns(df.where("block_num = 2"), gap=30).collect()] == [(0, "Body"), (1, "text.")]


def test_manifests(spark):
    data = [(" a ", "train", "manual", "l", "x/A.PNG", "False"), ("b", "train", "none", "l", "b", "false"), ("c", "heldout", "tool", None, "", "false"), ("  ", "train", "tool", "l", "y.png", "false"), (None, "train", "tool", "l", None, None)]
    m = spark.createDataFrame(data, "sample_id string, split string, label_source string, label_path string, relative_path string, local_only string")
    assert [r.sample_id for r in manifests.selected(m).collect()] == ["a", "b", "c"]
    assert [r.sample_id for r in manifests.selected(m, ["train"], ["b", "c"]).collect()] == ["b"]
    assert [r.route for r in manifests.with_route(m).collect()] == ["manual", "controls", "controls", "labelled", "labelled"]
    there = spark.createDataFrame([("x/A.PNG",), ("x/A.PNG",), ("b",)], "relative_path string")
    assert sorted(r.relative_path for r in manifests.payloads(m, there).collect()) == ["b", "x/A.PNG"]
    assert [r.relative_path for r in manifests.missing_files(m, there, "relative_path").collect()] == ["y.png"]
    assert [(r.status, r.reason) for r in manifests.with_suffix_status(m, ["png"]).collect()][:2] == [("ready", ""), ("skipped", "no_suffix")]


@pytest.mark.parametrize("value, want", [(3.0, "3"), (-2.0, "-2"), (0.125, "0.125"), (1.0000001, "1"), (10.5, "10.5")])
def test_numbers_as_text(spark, value, want):
    assert one(spark, t=T.number_text(F.lit(value))).t == want


def test_results_do_not_depend_on_partitions(spark):
    random.seed(3)
    data = [("s", random.choice("abc"), random.choice("abc")) for _ in range(300)]
    df = spark.createDataFrame(data, "sample string, gold string, pred string")
    assert rows(metrics.per_label(metrics.confusion(df))) == rows(metrics.per_label(metrics.confusion(df.repartition(7))))


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, start + dt.timedelta(minutes=20 * i), "a", 1.0, i % 2) for i in range(6)], "event_id long, ts timestamp, event_type string, value double, user_id int")
    events.write.parquet(str(tmp_path / "e"))
    stream = streams.parquet_stream(spark, str(tmp_path / "e"), events.schema)
    q = streams.tumbling(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("w")) == rows(streams.tumbling(events))
    q = streams.append_to(streams.new_rows(stream), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    checks = spark.createDataFrame([("f", "r1", 1), ("f", "r1", 2), ("f", "r2", 3)], "file string, result string, ts long")
    checks.write.parquet(str(tmp_path / "c"))
    q = streams.changes(streams.parquet_stream(spark, str(tmp_path / "c"), checks.schema)).writeStream.format("memory").queryName("ch").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.status for r in spark.table("ch").collect()) == ["changed", "first", "unchanged"]


def test_logistic_is_the_least_of_its_loss(spark):
    """At the fitted coefficients the gradient of the balanced, penalised loss vanishes."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(m, 1.0, (n, 3)) for m, n in ((0, 60), (1.5, 25), (-1, 15))])
    y = np.repeat([0, 1, 2], [60, 25, 15])
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, x)], "label int, values array<double>")
    model, predict = models.fit_logistic(df)
    z = (x - x.mean(0)) / x.std(0)
    w = len(y) / (3 * np.bincount(y)[y])
    w = w / w.sum()
    b, c = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    p = np.exp(z @ b.T + c)
    p /= p.sum(1, keepdims=True)
    error = w[:, None] * (p - (y[:, None] == np.arange(3)))
    assert np.abs(error.T @ z + b / len(y)).max() < 1e-4 and np.abs(error.sum(0)).max() < 1e-4
    got = predict(df).collect()
    assert np.mean([r.pred == r.label for r in got]) > 0.75


def test_stored_models(spark, tmp_path):
    """A model is made, written, read and used alike; accepted labels come first."""
    import numpy as np

    rng = np.random.default_rng(2)
    data = [(["a", "b", "c"][i % 3], float(rng.normal(i % 3)), str(rng.normal(-(i % 3))), i % 2 == 0, None) for i in range(90)] + [("a", 1.0, "", None, None)]
    df = spark.createDataFrame(data, "label string, f double, g string, h boolean, k double").repartition(3)
    model = models.build_model(df, ["f", "g", "h", "k", "absent"])
    x = np.array([[f, float(g) if g else 0.0, float(bool(h)), 0.0, 0.0] for _, f, g, h, _ in data])
    y = np.array([r[0] for r in data])
    scale = np.where(x.var(0) > 1e-12, x.std(0), 1.0)
    z = (x - x.mean(0)) / scale
    for label in "abc":
        pos, neg = z[y == label].mean(0), z[y != label].mean(0)
        assert np.allclose(model.weights[label], pos - neg) and np.isclose(model.bias[label], -((pos - neg) * (pos + neg) / 2).sum())
        raw = z @ (pos - neg) + model.bias[label]
        assert np.isclose(model.least[label][0], (raw[y == label].min() + raw[y != label].max()) / 2) and model.least[label][1] == 0.5
    again = models.LinearModel.of_json(model.to_json())
    assert again == model and model.about["sample_count"] == "91"
    scored = models.with_model_scores(df, again, BLOCK_LABELS).first()
    assert scored.model_paragraph == 0.0 and 0 < scored.model_a < 1
    raws = {k: z @ np.array(model.weights[k]) + model.bias[k] for k in "abc"}
    order = {(r[0], r[1], r[2]): i for i, r in enumerate(data)}
    for r in models.classified(df, again).collect():
        i = order[r.label, r.f, r.g]
        rank = sorted((not (raws[k][i] >= model.least[k][0] and raws[k][i] >= 0), -raws[k][i], k) for k in "abc")
        assert r.pred == rank[0][2] and r.score == pytest.approx(raws[r.pred][i]) and r.accepted == (not rank[0][0])
    assert models.build_model(df.where("false"), ["f"]).labels == []
