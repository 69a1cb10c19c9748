"""Differences of two checks of the same publications.

A check is a row ``file`` with JSON ``result``: {publication: {...}, items:
[{id, ...}], messages: [{ID, severity, message, additionalLocations, locations: [...]}]}.
``compare`` parses each result once and turns all its levels into one
key-value table; one aggregation by key holds both sides against each other.
Result rows are one a file: what a file lists (items, messages) is taken to fit
one row, as its JSON does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.operators.relations import first_wins, keyed_diff, last_wins, with_blank_ids

_MESSAGE = "array<struct<ID:string,severity:string,message:string,additionalLocations:int,locations:array<struct<fileName:string,line:int,column:int>>>>"


def publication_properties(checks: DataFrame) -> DataFrame:
    """file, property, value."""
    return checks.select("file", F.explode(F.from_json(F.get_json_object("result", "$.publication"), "map<string,string>")).alias("property", "value"))


def items(checks: DataFrame) -> DataFrame:
    """file, id, item (map of properties); of equal ids the last item stays."""
    rows = checks.select("file", F.posexplode(F.from_json(F.get_json_object("result", "$.items"), "array<map<string,string>>")).alias("seq", "item"))
    return last_wins(rows.select("file", F.col("item")["id"].alias("id"), F.to_json("item").alias("item"), "seq"), ["file", "id"], "seq").drop("seq").withColumn("item", F.from_json("item", "map<string,string>"))


def item_properties(checks: DataFrame) -> DataFrame:
    """file, id, property, value; referenced items are a set of their own."""
    return items(checks).select("file", "id", F.explode("item").alias("property", "value")).where("property not in ('id', 'referencedItems')")


def references(checks: DataFrame) -> DataFrame:
    """file, id, property, value: one row for each different item that an item refers to."""
    sets = items(checks).select("file", "id", F.explode(F.array_distinct(F.from_json(F.col("item")["referencedItems"], "array<string>"))).alias("property"))
    return sets.withColumn("value", F.lit(""))


def spine(checks: DataFrame) -> DataFrame:
    """file, id, spineIndex, checkSum of the items of the spine."""
    i = F.col("item")
    return items(checks).where(i["isSpineItem"] == "true").select("file", "id", i["spineIndex"].alias("spineIndex"), i["checkSum"].alias("checkSum"))


def messages(checks: DataFrame) -> DataFrame:
    """file, ID, severity, message, additional, locations, seq; blank ids are numbered, of equal ids the first stays."""
    rows = checks.select("file", F.posexplode(F.from_json(F.get_json_object("result", "$.messages"), _MESSAGE)).alias("seq", "m"))
    flat = rows.select("file", "seq", F.col("m.ID").alias("ID"), "m.severity", "m.message", F.coalesce("m.additionalLocations", F.lit(0)).alias("additional"), "m.locations")
    return first_wins(with_blank_ids(flat, "file", "ID", "seq"), ["file", "ID"], "seq")


def occurrences(rows: DataFrame) -> DataFrame:
    """messages with n: its locations, and the additional ones less the one that stands for them."""
    return rows.withColumn("n", F.coalesce(F.size("locations"), F.lit(0)) + F.when(F.col("additional") != 0, F.col("additional") - 1).otherwise(0))


def shown(rows: DataFrame, warnings: bool = False, usage: bool = False) -> DataFrame:
    """messages of fatal errors and errors; warnings and usage hints if asked for."""
    return rows.where(F.col("severity").isin("FATAL", "ERROR", *["WARNING"] * warnings, *["USAGE"] * usage))


def locations(rows: DataFrame) -> DataFrame:
    """file, ID, place (file-line-column), n: how often each place is named."""
    at = rows.select("file", "ID", F.explode("locations").alias("l"))
    name = F.when(F.length(F.coalesce("l.fileName", F.lit(""))) == 0, F.concat("ID", F.lit("HasNullFileNameLoc"))).otherwise(F.col("l.fileName"))
    place = F.concat_ws("-", name, "l.line", "l.column")
    return at.groupBy("file", "ID", place.alias("place")).agg(F.count("*").alias("n"))


def outcome(checks: DataFrame, severities: tuple[str, ...] = ("FATAL", "ERROR")) -> DataFrame:
    """file, n_errors, n_warnings, is_clean; messages of other severities do not count as errors."""
    seen = occurrences(messages(checks)).groupBy("file").agg(
        F.sum(F.when(F.col("severity").isin(*severities), F.col("n")).otherwise(0)).alias("n_errors"), F.sum(F.when(F.col("severity") == "WARNING", F.col("n")).otherwise(0)).alias("n_warnings")
    )
    return checks.select("file").join(seen, "file", "left").na.fill(0).withColumn("is_clean", F.col("n_errors") == 0)


_RESULT = "publication map<string,string>, items array<map<string,string>>, messages array<map<string,string>>"
_PLACES = "array<struct<fileName:string,line:int,column:int>>"


def _named(rows: Column, last: bool) -> Column:
    """Maps with an id once each: of equal ids the last or the first. Only lists with a repeated id are searched."""
    ids = F.transform(rows, lambda m: m["id"])
    there = (lambda i: F.slice(ids, i + 2, F.size(ids))) if last else (lambda i: F.slice(ids, F.lit(1), i))
    return F.when(F.size(F.array_distinct(ids)) == F.size(ids), rows).otherwise(F.filter(rows, lambda m, i: ~F.array_contains(there(i), m["id"])))


def _entries(checks: DataFrame) -> DataFrame:
    """file, level, id, property, value, shown: all levels of each check, from one parse of its result.

    An item or a message as a whole is the text of its sorted properties; a
    changed check sum is shown by its file name.
    """
    read = checks.select("file", F.from_json("result", _RESULT).alias("r"))
    maps = lambda c: F.coalesce(c, F.array().cast("array<map<string,string>>"))
    pairs = lambda m: F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))
    blank = lambda m: F.coalesce(F.trim(m["ID"]), F.lit("")) == ""
    with_id = lambda m, key: F.map_concat(F.map_filter(m, lambda k, v: k != "id"), F.create_map(F.lit("id"), key))
    messages = maps(F.col("r.messages"))
    named = F.transform(F.filter(messages, lambda m: ~blank(m)), lambda m: with_id(m, m["ID"]))
    unnamed = F.transform(F.filter(messages, blank), lambda m, i: with_id(m, F.concat(F.lit("BlankID_"), i + 1)))
    # a column of its own, so that the lists are made once
    lists = read.select("file", pairs(F.col("r.publication")).alias("pub"), _named(maps(F.col("r.items")), True).alias("items"), _named(F.concat(named, unnamed), False).alias("messages"), F.to_json(messages).alias("all"))
    none = F.lit(None).cast("string")

    def entry(level: str, key: Column, name: Column, value: Column, shown: Column | None = None) -> Column:
        return F.struct(F.lit(level).alias("level"), key.alias("id"), name.alias("property"), value.alias("value"), (value if shown is None else shown).alias("shown"))

    empty, whole = F.lit(""), lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    in_spine = F.filter("items", lambda i: i["isSpineItem"] == "true")
    properties = lambda rows, level, skipped: F.flatten(F.transform(rows, lambda m: F.transform(F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*skipped)), lambda e: entry(
        level, m["id"], e["key"], e["value"], F.when(e["key"] == "checkSum", m["fileName"]).otherwise(e["value"])))))
    place = lambda m, p: F.when(F.length(F.coalesce(p["fileName"], empty)) == 0, F.concat(m["id"], F.lit("HasNullFileNameLoc"))).otherwise(p["fileName"])
    parts = [
        F.transform("pub", lambda e: entry("Pub", empty, e["key"], e["value"])),
        F.transform(in_spine, lambda i: entry("Order", i["id"], empty, i["spineIndex"])),
        F.transform(in_spine, lambda i: entry("Content", i["id"], empty, i["checkSum"], i["fileName"])),
        F.transform("items", lambda i: entry("Mani", i["id"], empty, whole(i))),
        properties(F.col("items"), "ItemProperty", ("id", "referencedItems")),
        F.flatten(F.transform("items", lambda i: F.transform(F.array_distinct(F.coalesce(F.from_json(i["referencedItems"], "array<string>"), F.array().cast("array<string>"))), lambda x: entry("Refs", i["id"], x, empty)))),
        F.transform("messages", lambda m: entry("Mess", m["id"], empty, whole(m))),
        properties(F.col("messages"), "MessageProperty", ("id", "ID", "locations")),
        F.flatten(F.transform("messages", lambda m: F.transform(F.array_distinct(F.transform(F.coalesce(F.from_json(m["locations"], _PLACES), F.array().cast(_PLACES)), lambda p: F.concat_ws("-", place(m, p), p["line"], p["column"]))),
                                                                lambda at: entry("Loc", m["id"], at, empty)))),
        F.array(entry("All", empty, F.lit("messages"), F.sha2("all", 256), none)),
    ]
    return lists.select("file", F.inline(F.concat(*parts)))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, level, id, property, status, old_value, new_value over all levels of files checked on either side.

    Both sides go into one aggregation by key, so there is one shuffle and no
    join. Levels: Pub, Order and Content (of the spine), Mani and Mess (items and
    messages whole), ItemProperty, Refs, MessageProperty, Loc, and All, which
    says whether the list of messages is the same altogether.
    """
    both = _entries(old).withColumn("new", F.lit(False)).unionByName(_entries(new).withColumn("new", F.lit(True)))
    side = lambda is_new: F.max(F.when(F.col("new") == is_new, F.struct("value", "shown")))
    rows = both.groupBy("file", "level", "id", "property").agg(side(False).alias("o"), side(True).alias("n"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o.value").eqNullSafe(F.col("n.value")), "unchanged").otherwise("changed")
    return rows.select("file", "level", "id", "property", status.alias("status"), F.col("o.shown").alias("old_value"), F.col("n.shown").alias("new_value"))


def compare(old: DataFrame, new: DataFrame, only_last_content: bool = False) -> DataFrame:
    """file, level, n_added, n_removed, n_changed, n_unchanged, n_content (changed check sums of the spine), code for Pub, Spine, Mani, Refs, Mess and Loc.

    Codes of the first four summaries are written in the fixed forms of the
    reports: ``Pub==`` or ``Pub-A1-xR-C2``; ``Spine==-N3`` or
    ``Spine-N3-U2-A1-xR-OC1-xCC``; ``Mani==`` or ``Mani-xA-R1-xC``; ``Mess-A1-xR-xC``
    or ``Mess=!xA-xR-xC`` for equal lists. ``only_last_content`` keeps the older
    habit of counting at most one changed spine content a file.
    """
    diff = differences(old, new)
    at = lambda level, status: F.count_if((F.col("level") == level) & (F.col("status") == status))
    levels = ("Pub", "Order", "Content", "Mani", "Refs", "Mess", "Loc")
    counts = diff.groupBy("file").agg(
        *[at(level, s).alias(f"{level}_{s}") for level in levels for s in ("added", "removed", "changed", "unchanged")],
        F.max(F.when((F.col("level") == "Pub") & (F.col("property") == "nSpines"), F.col("new_value"))).alias("n_spines"), (at("All", "unchanged") > 0).alias("same_messages"),
    )
    n = lambda level, s: F.col(f"{level}_{s}")
    content = F.least(n("Content", "changed"), F.lit(1)) if only_last_content else n("Content", "changed")
    mark = lambda letters, c: F.when(c > 0, F.concat(F.lit(letters), c)).otherwise(f"x{letters}")
    three = lambda level: F.concat_ws("-", mark("A", n(level, "added")), mark("R", n(level, "removed")), mark("C", n(level, "changed")))
    none = lambda level: (n(level, "added") + n(level, "removed") + n(level, "changed")) == 0
    plain = lambda level: F.when(none(level), f"{level}==").otherwise(F.concat(F.lit(f"{level}-"), three(level)))
    spines = F.coalesce("n_spines", F.lit("None"))
    spine_code = F.when(none("Order") & (content == 0), F.concat(F.lit("Spine==-N"), spines)).otherwise(
        F.concat_ws("-", F.concat(F.lit("Spine-N"), spines), mark("U", n("Order", "unchanged")), mark("A", n("Order", "added")), mark("R", n("Order", "removed")), mark("OC", n("Order", "changed")), mark("CC", content))
    )
    message_code = F.concat(F.when(F.col("same_messages"), "Mess=!").otherwise("Mess-"), three("Mess"))
    codes = {"Pub": ("Pub", plain("Pub")), "Spine": ("Order", spine_code), "Mani": ("Mani", plain("Mani")), "Refs": ("Refs", plain("Refs")), "Mess": ("Mess", message_code), "Loc": ("Loc", plain("Loc"))}
    zero = F.lit(0).cast("long")
    out = [
        F.struct(F.lit(name).alias("level"), *[n(level, s).alias(f"n_{s}") for s in ("added", "removed", "changed", "unchanged")], (content if name == "Spine" else zero).alias("n_content"), code.alias("code"))
        for name, (level, code) in codes.items()
    ]
    return counts.select("file", F.inline(F.array(*out)))


def unchanged(compared: DataFrame) -> DataFrame:
    """file, is_unchanged: no difference of publication or items; spine and messages do not count."""
    touched = F.when(F.col("level").isin("Pub", "Mani"), F.col("n_added") + F.col("n_removed") + F.col("n_changed")).otherwise(0)
    return compared.groupBy("file").agg((F.sum(touched) == 0).alias("is_unchanged"))


def check_status(runs: DataFrame) -> DataFrame:
    """runs (file, is_dir, has_mimetype, error, timed_out, n_errors) with ``status``: what a run log says of each file."""
    archive = F.lower("file").endswith(".epub")
    status = (
        F.when(~archive & ~(F.col("is_dir") & F.col("has_mimetype")), "skipped").when(F.coalesce("timed_out", F.lit(False)), "timeout").when(F.col("error") == "not_found", "not_found")
        .when(F.coalesce("error", F.lit("")) != "", "exception").when(F.col("n_errors") > 0, "severe").otherwise("clean")
    )
    return runs.withColumn("status", status).withColumn("is_expanded", ~archive & F.col("is_dir") & F.col("has_mimetype"))


def report_name(file: Column, by_number: bool = False) -> Column:
    """Name of a file's report; ``by_number`` takes the thirteen digits that lead its name, where they do."""
    plain = F.concat(file, F.lit("Check.json"))
    return F.when(file.rlike("^[0-9]{13}"), F.concat(F.substring(file, 1, 13), F.lit(".ePubCheck.json"))).otherwise(plain) if by_number else plain


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status of two listings (path, sha256); where both have a ``content`` column, also n_lines: lines that only one side has, for changed texts."""
    if "content" not in old.columns or "content" not in new.columns:
        return keyed_diff(old, new, ["path"], "sha256").select("path", "status")
    side = lambda df, p: df.select("path", F.struct("sha256", F.split(F.decode(F.col("content").cast("binary"), "UTF-8"), "\r?\n").alias("lines")).alias(p))
    both = side(old, "o").join(side(new, "n"), "path", "full_outer")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o.sha256") == F.col("n.sha256"), "unchanged").otherwise("changed")
    only = F.size(F.array_except("o.lines", "n.lines")) + F.size(F.array_except("n.lines", "o.lines"))
    return both.select("path", status.alias("status"), F.when(status == "changed", only).alias("n_lines"))
