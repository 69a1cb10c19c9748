"""SpotSigs document fingerprints.

A spot signature is a common word and the chain of content words that follow it.
A fingerprint is the sorted set of a text's signatures, each a 32-bit hash in
hex. Sets are held against each other by their lengths first and then with a bound
that stops hopeless comparisons early (``pruned_likeness``); where a value is asked
for whatever it is, an exact count follows. ``near_pairs`` finds the sets with a
likeness of at least a threshold: classes of equal sets are partitioned by length
so that similar ones lie in the same partition or neighbouring ones, and meet on
their rarest signatures.

Defined cases: a null text is empty and has the empty fingerprint; two empty
fingerprints have likeness 1; a text without any common word that is followed by
a chain uses every word as an anchor, and a shorter text its whole word
sequence; texts without a word are empty. Rows that share a doc_id follow each
other by the hash of the text, then by text, falling; null ids come last. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import small_batches, stored, texts_in

ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he her his in is it its of on or she that the their they this to was were which will with you "
    "der die das den dem des ein eine einen und in im zu mit von auf ist nicht sich als auch für an es war bei nach am aus wie "
    "le la les un une des du de et en est que qui dans pour par sur au aux il elle ne pas avec ce se son sa "
    "el los las una del y que en es por con para se su no al lo como más".split()
)
CHAIN = 2
#: Sets are near from this likeness on.
LEAST = 0.8
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…–—¿¡"
ROWS_A_TASK = 10_000
#: Id ranges never exceed this, so what the driver holds of them is bounded; larger tables get larger ranges, sorted on disk.
MOST_RANGES = 20_000


def signatures(text: str | None, chain: int = CHAIN) -> set[int]:
    """The 32-bit hashes of a whole text's spot signatures."""
    from xxhash import xxh32_intdigest

    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for raw in (text or "").lower().split():
        word = raw.strip(EDGES)
        if word in ANCHORS:
            spots.append((word, len(content)))
        elif word:
            content.append(word)
    most = len(content) - chain
    found = {xxh32_intdigest(f"{word} {' '.join(content[k : k + chain])}") for word, k in spots if k <= most}
    if found:
        return found
    words = [w for w in (raw.strip(EDGES) for raw in (text or "").lower().split()) if w]
    if len(words) <= chain:
        return {xxh32_intdigest(" ".join(words))} if words else set()
    return {xxh32_intdigest(" ".join(words[k : k + chain + 1])) for k in range(len(words) - chain)}


def written(found: list[int]) -> str:
    """The sorted signatures in hex."""
    return "".join(f"{x:08x}" for x in found)


def likeness(a: set[int], b: set[int]) -> float:
    """Jaccard; 1 for two empty sets."""
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def pruned_likeness(a: list[int], b: list[int], least: float) -> float | None:
    """Jaccard of two sorted lists, or None once it cannot reach ``least``."""
    if len(a) > len(b):
        a, b = b, a
    if not b:
        return 1.0
    if len(a) < least * len(b):
        return None
    need, i, j, both = least / (1 + least) * (len(a) + len(b)) - 1e-9, 0, 0, 0
    while i < len(a) and j < len(b):
        if both + min(len(a) - i, len(b) - j) < need:
            return None
        if a[i] == b[j]:
            i, j, both = i + 1, j + 1, both + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return both / (len(a) + len(b) - both) if both >= need else None


def whole_likeness(a: list[int], b: list[int], least: float = LEAST) -> float:
    """Jaccard of two sorted lists: by the pruned comparison, and by an exact count where that gives up."""
    found = pruned_likeness(a, b, least)
    return likeness(set(a), set(b)) if found is None else found


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _structs(values: list[tuple[int, int]]) -> Column:
    """A literal array of (id, hash)."""
    return F.from_json(F.lit(json.dumps([{"d": d, "h": h} for d, h in values])), "array<struct<d:bigint,h:bigint>>")


def _longs(values: list) -> str:
    """SQL of an array of longs."""
    return f"cast(array({', '.join('null' if v is None else f'{v}L' for v in values)}) as array<bigint>)"


def _place(bounds: list[tuple[int, int]], key: Column) -> Column:
    """How many of the sorted bounds are at most key (a struct of id and hash; a null id is below all), by a two-level search in literal arrays."""
    side = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    if not rows:
        return F.lit(0)
    upto = lambda values: F.size(F.filter(values, lambda x: x <= key))
    at = F.greatest(upto(_structs([r[0] for r in rows])) - 1, F.lit(0))
    table = F.from_json(F.lit(json.dumps([[{"d": d, "h": h} for d, h in r] for r in rows])), "array<array<struct<d:bigint,h:bigint>>>")
    return at * side + upto(F.get(table, at))


def with_following(docs: DataFrame) -> DataFrame:
    """part, last, doc_id, text in partitions by part, sorted so that each row's follower (descending doc_id, the first after the last) is the next row.

    Pairs of id and text hash are cut into at most ``MOST_RANGES`` ranges at a hash
    sample of about 40 distinct ones a range, so the rows of one id (or of none)
    are not one task's; one shuffle brings each range to its task. The first row
    of the range below comes along marked ``last``: it only follows.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = stored(rows.select("doc_id", "h"), "spot-ids")
    n = ids.count()
    tasks = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_TASK)))
    below = int(min(1.0, 40 * tasks / max(n, 1)) * (1 << 40)) + 1
    sample = ids.where(f"pmod(xxhash64(doc_id, h), {1 << 40}) < {below}").distinct().toPandas()
    keys = sorted(zip((None if d is pd.NA or d != d else int(d) for d in sample["doc_id"].astype("Int64")), map(int, sample["h"])), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    bounds = [k for i, k in enumerate(keys) if i and i * tasks // len(keys) != (i - 1) * tasks // len(keys)]
    key = F.struct(F.col("doc_id").alias("d"), F.col("h").alias("h"))
    part = _place(bounds, key)
    heads = {r["part"]: (r["head"]["d"], r["head"]["h"]) for r in ids.groupBy(part.alias("part")).agg(F.max(key).alias("head")).collect()}  # one a range
    order = sorted(heads)
    above = {p: order[(k + 1) % len(order)] for k, p in enumerate(order)}
    array = lambda values: F.expr(_longs([values.get(p) for p in range(len(bounds) + 1)]))
    head = F.col("doc_id").eqNullSafe(F.get(array({p: d for p, (d, _) in heads.items()}), F.col("part"))) & (F.col("h") == F.get(array({p: h for p, (_, h) in heads.items()}), F.col("part")))
    placed = rows.withColumn("part", part.cast("int"))
    halo = placed.where(head).groupBy("part").agg(F.max("text").alias("text"), F.max("doc_id").alias("doc_id"), F.max("h").alias("h"))
    halo = halo.select("doc_id", "text", "h", F.get(array(above), F.col("part")).cast("int").alias("part"), F.lit(True).alias("last"))
    dealt = placed.withColumn("last", F.lit(False)).unionByName(halo)
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "last", F.col("doc_id").desc_nulls_last(), F.desc("h"), F.desc("text")).select("part", "last", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names, held = [x.split()[0] for x in schema.split(", ")], None

        def row(key, text: str, own: list[int], following: str, after: list[int]) -> tuple:
            changed = edited(text, following)
            other = sorted(signatures(changed))
            return key, len(text), sha256(changed.encode()).hexdigest(), written(own), written(other), whole_likeness(own, other), whole_likeness(own, after)

        for batch in batches:
            parts, lasts, keys = (batch.column(c).to_pylist() for c in ("part", "last", "doc_id"))
            for start, texts in texts_in(batch, "text"):
                out = []
                for i, text in enumerate(texts, start):
                    if held and held[4]:
                        held = None
                    found = sorted(signatures(text))
                    if held:
                        out.append(row(held[1], held[2], held[3], text, found))
                    held = (parts[i], keys[i], text, found, lasts[i])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return with_following(docs).mapInArrow(run, schema)


def classes(docs: DataFrame) -> DataFrame:
    """class (a hash of the signatures), first (smallest doc_id, null if all are), n, size, signatures (sorted): one row for each distinct fingerprint."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [sorted(signatures(t)) for _, texts in texts_in(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "signatures"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, signatures array<long>")
    each = stored(rows.withColumn("class", F.xxhash64("signatures")), "spot-rows")
    return each.groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("signatures").alias("signatures")).withColumn("size", F.size("signatures"))


def near_pairs(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b (classes, a < b), first_a, first_b (their smallest ids), likeness: pairs of classes of equal fingerprints with a likeness of at least ``least``. Empty fingerprints are no class.

    Lengths are cut at powers of 1/least: a set can only be near sets of its own
    or the next length range. In a range, sets meet on any of their
    ``len - ceil(least * len) + 1`` rarest signatures, where near sets must. Common
    signatures come last in that order, so what many texts share brings no
    pairs. Both sides of the join are plain tables, so a crowded signature can be split.
    """
    sets = stored(classes(docs).where("size > 0"), "spot-classes")
    common = sets.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    each = sets.select("class", "size", F.explode("signatures").alias("s")).join(stored(common, "spot-common"), "s")
    order = F.array_sort(F.collect_list(F.struct("n", "s")))  # the signatures of one set
    rare = each.groupBy("class", "size").agg(order.alias("o")).select("class", "size", F.explode(F.slice("o", F.lit(1), (F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1).cast("int"))).alias("o"))
    rare = stored(rare.select("class", "size", F.col("o.s").alias("s"), F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / least))).alias("range")), "spot-rare")
    low = rare.select(F.col("class").alias("x"), F.col("size").alias("nx"), "s", F.explode(F.array("range", F.col("range") + 1)).alias("range"))
    high = rare.select(F.col("class").alias("y"), F.col("size").alias("ny"), "s", "range")
    small_first = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    pairs = stored(low.join(high, ["s", "range"]).where(small_first & (F.col("nx") >= F.lit(least) * F.col("ny"))).select("x", "y").distinct(), "spot-tried")
    side = lambda k: sets.select(F.col("class").alias(k), F.col("first").alias(f"first_{k}"), F.col("signatures").alias(f"s{k}"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.float64()]
        for batch in batches:
            out = []
            for x, y, fx, fy, a, b in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "first_x", "first_y", "sx", "sy"))):
                value = pruned_likeness(a, b, least)
                if value is not None:
                    out.append((x, y, fx, fy, value) if x < y else (y, x, fy, fx, value))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["a", "b", "first_a", "first_b", "likeness"])

    return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(compare, "a long, b long, first_a long, first_b long, likeness double")
