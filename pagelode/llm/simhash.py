"""SimHash near-duplicates by BK-trees over shards.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of its
word shingles. Distinct fingerprints are dealt to shards so that any two within
the radius meet in one: of four 16-bit blocks at least two are equal when at
most two bits differ, so each fingerprint goes to six shards, one for each pair
of blocks. A shard with more than ``HOT_SHARD`` members is dealt again by pairs
of the four bytes it does not fix, which bounds every shard at 65,536 members.
In each shard a BK-tree (children keyed by the Hamming distance to their
parent) is searched along the edges within the radius. The shards' trees
together grow with the corpus, so they are not broadcast: fingerprints travel to
the tree of their shard. A shard returns a spanning forest of its links, never
all pairs, and connected components are found by star contraction on tables.

``keep_first`` asks for near copies instead: texts whose sets of five-word
shingles have a Jaccard likeness of ``LIKE`` or more. Their fingerprints differ
in about ten bits, more than blocks can find. So shards are made of min-hash
bands (``BANDS`` choices of ``ROWS`` of ``HASHES`` min-hashes), and the BK-tree of
each shard is searched with a radius of ``NEAR_RADIUS`` bits. What it finds is
held against two bits of each min-hash and, where these agree ``AGREE`` times,
whole sets are compared. Each set of a shard first tries the likest and the most
copied other one. Sets still apart are then held against whatever else the tree
finds, within the shard: each brings the hashes by which it differs from the most
copied set of the shard's largest component, from which the exact likeness of any
two follows, and a shard returns a spanning forest of the links. So a large group
needs no table of pairs, however many of them are just not near. A shard of more
than ``HOT_SHARD`` sets is cut into trees; its sets first search their own, and
those still apart from the largest component then search all. A pair of
likeness 0.8 is missed with a probability of 0.02 (bands 0.006, bits 0.01), of
0.85 or more with less than 0.001, and none below ``LIKE`` is linked.

Defined cases: null and blank texts have fingerprint zero and link like any
other; rows that share a doc_id each get a row; a null doc_id takes part but is
never a component's smallest id unless all its ids are null; empty tables give
empty results; further columns are ignored (``keep_first`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import bitmap, small_batches, stored, texts_in, with_likely

RADIUS = 2
HOT_SHARD = 4096
EDGES_A_FILE = 50_000
PAIRS = tuple(combinations(range(4), 2))
#: Of near copies: the least Jaccard likeness (as a fraction), min-hashes, bands and min-hashes of a band.
LIKE = (4, 5)
HASHES, BANDS, ROWS = 192, 48, 9
#: Fingerprints of sets of likeness 0.8 differ in 9.7 bits (deviation 2.9); of their two-bit min-hashes 163 agree (deviation 5).
NEAR_RADIUS, AGREE = 20, 150


def fingerprint(text: str | None, shingle: int = 3, at_once: int = 65_536) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for start in range(0, n, at_once):
        some = words[start : start + at_once + shingle - 1]
        runs = zip(*(some[k:] for k in range(shingle))) if len(words) >= shingle else [some]
        hashes = np.array([xxh64_intdigest(b" ".join(r), 42) for r in runs], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), text_hash."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = np.array([fingerprint(t, shingle) for _, texts in texts_in(batch, "text") for t in texts], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view("<i8")), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


class BKTree:
    """Fingerprints under integer Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def find(self, value: int, radius: int) -> list[int]:
        """Places of all members within the radius."""
        found, todo, values, children = [], [0] if self.values else [], self.values, self.children
        while todo:
            node = todo.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            edges = children[node]
            if edges:
                if len(edges) <= 2 * radius + 1:
                    todo += [c for d, c in edges.items() if -radius <= d - distance <= radius]
                else:
                    todo += [edges[d] for d in range(distance - radius, distance + radius + 1) if d in edges]
        return found

    def add(self, value: int) -> int:
        place = len(self.values)
        node = 0
        while place:
            edges = self.children[node]
            distance = (self.values[node] ^ value).bit_count()
            if distance not in edges:
                edges[distance] = place
                break
            node = edges[distance]
        self.values.append(value)
        self.children.append({})
        return place


def shard_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius among distinct fingerprints."""
    tree, parent, links = BKTree(), [], []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in members:
        near = tree.find(value, radius)
        place = tree.add(value)
        parent.append(place)
        for other in near:
            a, b = top(other), top(place)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((value, tree.values[other]))
    return links


def _pair_keys(blocks: list[Column], bits: int) -> Column:
    """An array of six keys, one for each pair of the four blocks."""
    return F.array(*[F.shiftleft(F.lit(k).cast("long"), 2 * bits).bitwiseOR(F.shiftleft(blocks[i], bits)).bitwiseOR(blocks[j]) for k, (i, j) in enumerate(PAIRS)])


def _sharded(fps: DataFrame) -> DataFrame:
    """fp, shard, part: rows of all shards, large ones dealt again."""
    bits = lambda shift, mask: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask)).cast("long")
    keyed = fps.select("fp", F.explode(_pair_keys([bits(16 * i, 0xFFFF) for i in range(4)], 16)).alias("shard"))
    hot = stored(keyed.groupBy("shard").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_SHARD), "simhash-hot")
    free = F.lit(None).cast("array<bigint>")
    for k, (i, j) in enumerate(PAIRS):
        a, b = (x for x in range(4) if x not in (i, j))
        again = _pair_keys([bits(16 * a, 0xFF), bits(16 * a + 8, 0xFF), bits(16 * b, 0xFF), bits(16 * b + 8, 0xFF)], 8)
        free = F.when(F.shiftright("shard", 32) == k, again).otherwise(free)
    dealt = keyed.join(hot, "shard", "left").withColumn("_parts", F.when(F.col("_n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(free))
    return dealt.select("fp", "shard", F.explode("_parts").alias("part"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links among distinct fingerprints fp that connect whatever is within the radius. u > v as signed longs."""
    if radius > 2:
        raise ValueError("four blocks find radii up to 2")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, members = None, []

        def linked(found: list[tuple[int, int]]):
            pairs = np.array(found, "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["u", "v"])

        for batch in batches:
            shard, part, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "fp"))
            if not len(fp):
                continue
            starts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(fp)]
            found = []
            for a, b in zip(starts, starts[1:]):
                here = (int(shard[a]), int(part[a]))
                if here != key:
                    if len(members) > 1:
                        found += _signed(members, radius)
                    key, members = here, []
                members += fp[a:b].tolist()
            yield linked(found)
        if len(members) > 1:
            yield linked(_signed(members, radius))

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _sharded(fps).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "fp")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _signed(members: list[int], radius: int) -> list[tuple[int, int]]:
    mask, sign = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x
    return [(sign(a), sign(b)) for a, b in shard_links([m & mask for m in members], radius)]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for the ends of edges (u > v), by large-star and small-star rounds.

    Each half-round groups by node with partial sums and joins the smallest
    neighbour back; both tables are written first, so that joins on a crowded
    node can be split, in a file for about ``EDGES_A_FILE`` edges. Stops when a
    round changes nothing.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(df.coalesce(files), name)

    def smallest(pairs: DataFrame) -> DataFrame:
        return kept(pairs.groupBy("u").agg(F.min("v").alias("m")), "cc-min")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = stored(edges, "cc-edges")
    before = state(now)
    files = 1 + before[0] // EDGES_A_FILE
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = smallest(both)
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        now = kept(larger.distinct(), "cc-large")
        least = smallest(now)
        joined = now.join(least, "u")
        pulled = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = kept(pulled.distinct(), "cc-small")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, text_hash: one row for each row of docs."""
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-classes")
    comps = stored(components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root"), "simhash-comps")
    members = stored(comps.join(classes, "fp").select("fp", "root", "first"), "simhash-members")
    heads = stored(members.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-heads")
    linked = members.join(heads, "root").select("fp", "component_id")
    copies = classes.where("n > 1").join(comps.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    named = stored(linked.union(copies), "simhash-named")
    rows = prints.join(named, "fp", "left")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")


def shingle_set(text: str | None, shingle: int = 5, at_once: int = 65_536):
    """Sorted distinct XXH64 hashes of a whole text's word shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    found = np.empty(0, "<u8")
    for start in range(0, max(1, len(words) - shingle + 1) if words else 0, at_once):
        some = words[start : start + at_once + shingle - 1]
        runs = zip(*(some[k:] for k in range(shingle))) if len(words) >= shingle else [some]
        found = np.union1d(found, np.array([xxh64_intdigest(b" ".join(r), 42) for r in runs], "<u8"))
    return found


def set_hash(hashes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), 42)


@cache
def _permutations():
    """Multipliers and addends of the min-hashes, and which of them each band takes."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(42))
    times, plus = rng.integers(0, 1 << 64, (2, HASHES), "u8")
    return times | np.uint64(1), plus, np.array([rng.choice(HASHES, ROWS, replace=False) for _ in range(BANDS)])


def sketch(hashes, at_once: int = 512) -> tuple[int, bytes, list[int]]:
    """Of a shingle set: its 64-bit SimHash, two bits of each min-hash, and one key for each band; no keys for sets so small that only equal ones are near."""
    import numpy as np
    from xxhash import xxh64_intdigest

    times, plus, bands = _permutations()
    least, total = np.full(HASHES, (1 << 64) - 1, "<u8"), np.zeros(64, np.int64)
    for start in range(0, len(hashes), at_once):
        some = hashes[start : start + at_once]
        np.minimum(least, (some[:, None] * times + plus).min(axis=0), out=least)
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])
    low = (least & np.uint64(3)).astype(np.uint8)
    bits = (low[0::4] | low[1::4] << 2 | low[2::4] << 4 | low[3::4] << 6).tobytes()
    if len(hashes) * (LIKE[1] - LIKE[0]) < LIKE[0]:
        return fp, bits, []
    raw, width = least[bands].tobytes(), 8 * ROWS
    return fp, bits, [xxh64_intdigest(raw[width * k : width * (k + 1)], k) for k in range(BANDS)]


def _lists(values: list):
    """An Arrow column of lists of unsigned hashes, as signed longs."""
    import numpy as np
    import pyarrow as pa

    flat = np.concatenate([np.empty(0, "<u8"), *(np.asarray(v, "<u8") for v in values)]).astype("<u8", copy=False)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat.view("<i8")))


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, set (the hash of the shingle set), size (of the set), and its sketch: fp, bits, keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        signed = lambda values: pa.array(np.array(values, "<u8").view("<i8"))
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for _, texts in texts_in(batch, "text"):
                for text in texts:
                    found = shingle_set(text, shingle)
                    for column, value in zip(out, (set_hash(found), len(found), *sketch(found))):
                        column.append(value)
            sets, sizes, fps, bits, keys = out
            columns = [batch.column("doc_id"), batch.column("text_hash"), signed(sets), pa.array(sizes, pa.int64()), signed(fps), pa.array(bits, pa.binary()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "set", "size", "fp", "bits", "keys"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, set long, size long, fp long, bits binary, keys array<long>")


_TWOS = int.from_bytes(b"\x55" * (HASHES // 4), "little")


def _alike(one: tuple, other: tuple) -> int | None:
    """Of members that begin (set, size, fp, bits): how many two-bit min-hashes differ; None if they cannot be near."""
    part, of = LIKE
    if one[0] == other[0] or min(one[1], other[1]) * of < max(one[1], other[1]) * part:
        return None
    differ = one[3] ^ other[3]
    apart = ((differ | differ >> 1) & _TWOS).bit_count()
    return apart if apart <= HASHES - AGREE else None


def _tree(members: list[tuple]) -> tuple[BKTree, list[tuple]]:
    """A BK-tree of the own members' fingerprints, and these members by place."""
    tree, kept = BKTree(), []
    for m in members:
        if m[4]:
            tree.add(m[2])
            kept.append(m)
    return tree, kept


def shard_pairs(members: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Pairs (a, size of a, b, size of b; a < b) of one shard that may be near, from members (set, size, fp, bits, own, copies): each member takes its likest and its most copied one."""
    tree, kept = _tree(members)
    found = set()
    for m in members:
        likest = copied = None
        for place in tree.find(m[2], NEAR_RADIUS):
            it = kept[place]
            if (apart := _alike(m, it)) is None:
                continue
            b, other, copies = it[0], it[1], it[5]
            likest, copied = min(likest or (apart, -copies, b, other), (apart, -copies, b, other)), min(copied or (-copies, b, other), (-copies, b, other))
        for *_, b, other in filter(None, (likest, copied)):
            found.add((m[0], m[1], b, other) if m[0] < b else (b, other, m[0], m[1]))
    return list(found)


def shard_joins(members: list[tuple]) -> list[tuple[int, int]]:
    """Links (u > v) of one shard that join components, from members (set, size, fp, bits, own, root, main, lost, differ).

    ``differ`` are the hashes (an array) by which a set differs from one set that the
    whole shard is held against, ``lost`` how many of them the set lacks. Two sets share
    what that set has and neither lacks, and the hashes that both add; counting the
    differences that both have gives this exactly. Members of the component ``main``
    are only searched for; those joined already are not compared again.
    """
    part, of = LIKE
    tree, kept = _tree(members)
    parent, found, known = {}, [], {}

    def differences(m: tuple) -> frozenset:
        if m[0] not in known:
            known[m[0]] = frozenset(m[8].tolist())
        return known[m[0]]

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for m in members:
        one, size, fp, _, _, root, main, lost, differ = m
        if root == main:
            continue
        held = size + lost - len(differ)  # what it has of the set that all are held against
        for place in tree.find(fp, NEAR_RADIUS):
            it = kept[place]
            if (a := top(root)) == (b := top(it[5])) or _alike(m, it) is None:
                continue
            if (held - it[7] + len(differences(m) & differences(it))) * (part + of) >= (size + it[1]) * part:
                parent[a] = b
                found.append((max(one, it[0]), min(one, it[0])))
    return found


def _by_shard(met: DataFrame, more: list[str], judge, names: list[str]) -> DataFrame:
    """The rows (long columns, as named) that judge gives for the members of each shard of met (key, _n, set, size, fp, bits, and more), each once.

    A shard is cut into parts with a tree each, by set and key, so that others meet
    in each band; members with a root that is not the ``main`` one go to all of them.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, members = None, []

        def table(found: list):
            rows = np.array(found, "<i8").reshape(-1, len(names))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(names))], names)

        def values(column) -> list:
            if not pa.types.is_list(column.type):
                return column.to_pylist()
            flat, ends = column.values.to_numpy(), column.offsets.to_pylist()
            return [flat[a:b] for a, b in zip(ends, ends[1:])]

        for batch in batches:
            found = []
            for k, p, one, size, fp, bits, own, *rest in zip(*(values(batch.column(c)) for c in columns)):
                if (k, p) != key:
                    if len(members) > 1:
                        found += judge(members)
                    key, members = (k, p), []
                members.append((one, size, fp & (1 << 64) - 1, int.from_bytes(bits, "little"), own, *rest))
            yield table(found)
        if len(members) > 1:
            yield table(judge(members))

    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.ceil(F.col("_n") / HOT_SHARD)
    mine = F.pmod(F.xxhash64("set", "key"), parts)
    searched = F.when(F.col("root") == F.col("main"), F.array(mine)).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1)) if "root" in more else F.array(mine)
    dealt = met.withColumn("part", F.explode(searched)).withColumn("own", mine == F.col("part"))
    columns = ["key", "part", "set", "size", "fp", "bits", "own", *more]
    rows = dealt.select(*columns).repartition(n, "key", "part").sortWithinPartitions("key", "part", "set")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """set, grams: the shingle hashes of the wanted sets, from one text of each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for _, texts in texts_in(batch, "text", 64):
                found = [shingle_set(t, shingle) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([set_hash(g) for g in found], "<u8").view("<i8")), _lists(found)], ["set", "grams"])

    picks = stored(classes.join(wanted, "set", "left_semi").select(F.col("text_hash").alias("_hash")), "near-picks")
    texts = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    texts = with_likely(texts, F.col("_text"), bitmap(picks, "near-bitmap")).where("_likely").drop("_likely").join(picks, F.col("_text") == F.col("_hash"), "left_semi")
    return stored(texts.dropDuplicates(["_text"]).select("text").mapInArrow(run, "set long, grams array<long>"), "near-sets")


def _near(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """u, v: those pairs a, na, b, nb (sets and their sizes) whose likeness is LIKE or more. u > v."""
    part, of = LIKE
    sets = _whole_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), shingle)
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("grams").alias("_a")), "a").join(sets.select(F.col("set").alias("b"), F.col("grams").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(shared * (part + of) >= (F.col("na") + F.col("nb")) * part).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _differences(docs: DataFrame, classes: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """set, main, lost, differ: how each set of members (set, n, root, main) differs from the most copied one that they have of the component main."""
    sets = _whole_sets(docs, classes, members.select("set").distinct(), shingle)
    heads = stored(members.where("root = main").groupBy("main").agg(F.max_by("set", F.struct("n", "set")).alias("_head")), "near-heads")
    both = members.select("set", "main").distinct().join(heads, "main").join(sets, "set").join(sets.select(F.col("set").alias("_head"), F.col("grams").alias("_grams")), "_head")
    lost = F.array_except("_grams", "grams")
    return stored(both.select("set", "main", F.size(lost).cast("long").alias("lost"), F.concat(lost, F.array_except("grams", "_grams")).alias("differ")), "near-differences")


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, root (a set of the row's component): one row for each row of docs."""
    prints = stored(sketches(docs, shingle), "near-prints")
    one = F.first(F.struct("size", "fp", "bits", "keys"))
    classes = stored(prints.groupBy("set").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash"), one.alias("s")).select("set", "n", "text_hash", "s.*"), "near-classes")
    keys = stored(classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"), "near-keys")
    banded = with_likely(classes.select("set", F.explode("keys").alias("key")), F.col("key"), bitmap(keys.select("key"), "near-bitmap")).where("_likely").select("set", "key")
    met = stored(banded.join(keys, "key"), "near-met")
    of = classes.select("set", "size", "n", "fp", "bits")
    tried = stored(_by_shard(met.join(of, "set"), ["n"], shard_pairs, ["a", "na", "b", "nb"]), "near-tried")
    edges = stored(_near(docs, classes, tried, shingle), "near-links")
    comps = stored(components(edges), "near-comps")
    rooted = stored(met.join(comps.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")), "near-rooted")
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("_m"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("_k"), F.max_by("root", F.struct("_m", "root")).alias("main")).where("_k > 1").select("key", "main")
    members = stored(rooted.join(stored(mixed, "near-mixed"), "key").join(of, "set"), "near-members")
    differing = members.join(_differences(docs, classes, members, shingle), ["set", "main"])
    found = stored(_by_shard(differing, ["root", "main", "lost", "differ"], shard_joins, ["u", "v"]), "near-links")
    if not found.isEmpty():
        comps = stored(components(edges.union(found)), "near-comps")
    rows = prints.join(comps.withColumnRenamed("node", "set"), "set", "left")
    return rows.select("doc_id", "text_hash", F.coalesce("root", "set").alias("root"))


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs, with their columns, and of each component of near copies only the row of the smallest doc_id (null last), then text hash; of rows that repeat both, one stays."""
    found = stored(near_copies(docs, shingle), "near-found")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    firsts = found.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("_n")).where("_n > 1").select("root", "first")
    gone = found.join(stored(firsts, "near-firsts"), "root").where(place != F.col("first")).select("doc_id", "text_hash").distinct().withColumn("gone", F.lit(True))
    again = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id", "text_hash", F.lit(False).alias("gone"))
    marks = stored(gone.unionByName(again).groupBy("doc_id", "text_hash").agg(F.max("gone").alias("gone")), "near-marks")
    key = lambda d, h: F.xxhash64(d, h)
    bits = bitmap(marks.select(key("doc_id", "text_hash")), "near-bitmap")
    marks = marks.select(F.struct(F.col("doc_id").alias("id"), "text_hash", "gone").alias("_mark"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    whole = with_likely(whole, key("_id", "_hash"), bits)
    clear = whole.where("not _likely").select("_doc.*")
    joined = whole.where("_likely").join(marks, F.col("_id").eqNullSafe(F.col("_mark.id")) & (F.col("_hash") == F.col("_mark.text_hash")), "left").where("_mark is null or not _mark.gone")
    if again.isEmpty():
        return clear.union(joined.select("_doc.*"))
    repeated = joined.where("_mark is not null").groupBy("_id", "_hash").agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc"))
    return clear.union(joined.where("_mark is null").select("_doc.*")).union(repeated.select("_doc.*"))
