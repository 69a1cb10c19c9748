"""Mixing, packing, SimHash, fingerprints, token counts, WARC, pipeline."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from array import array
from collections import defaultdict

import pytest
from oracle import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelode.llm import common, mixing, packing, simhash, spotsigs, token_counts, warc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_cases(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    texts = {r.doc_id: r.text for r in odd_docs.select("doc_id", "text").collect()}
    assert len(got) == odd_docs.count() and all(r.size == len(words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size for r in got)
    assert rows(mixing.mix(odd_docs.repartition(5))) == rows(mixing.mix(odd_docs))
    assert mixing.mix(no_docs).count() == 0
    times = {(r.doc_id, r.source): r.times_taken for r in got}
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r.times_taken for r in got) and times


def test_targets_hold_though_ids_repeat(spark):
    """Rows that share an id, or have none, are parted by their texts; rows that repeat are taken by number."""
    text = lambda i, n: " ".join([f"w{i}"] * n)
    for data in (
        [(None, "a", text(i, 10), i) for i in range(40)] + [(5, "b", text(7, 10), 0)] * 60 + [(i, "c", text(i, 3), i) for i in range(5)],
        [(None, "a", None, 0), (None, "a", "x", 1), (1, None, text(1, 20), 2), (1, None, text(1, 20), 3), (1, None, text(2, 20), 4), (2, "b", text(3, 40), 5)],
    ):
        docs = spark.createDataFrame(data, "doc_id long, source string, text string, _i int").repartition(3)
        for name in ("_s", "_times", "_below", "_doc", "_k", "_n", "_run", "_key", "_h", "size", "cut_source", "cut_at", "h", "more"):
            docs = docs.selectExpr("*", f"'kept' as {name}")
        got = mixing.mix(docs).collect()
        assert len(got) == len(data)
        for source in {r.source for r in got}:
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1e-6
        assert rows(mixing.mix(docs.repartition(7))) == rows(mixing.mix(docs))
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns and out.count() == sum(r.times_taken for r in got)
        assert sorted((r.doc_id, r.source, len(words(r.text))) for r in out.collect() if r.doc_id is not None and r.source) == sorted((r.doc_id, r.source, r.size) for r in got for _ in range(r.times_taken) if r.doc_id is not None and r.source)
        assert {r._s for r in out.collect()} == {"kept"} and {r._i for r in out.where("source = 'b'").collect()} <= {d[3] for d in data}


def test_targets_are_the_reshared_weights(spark):
    def brute(sizes, weights, share):
        total, out, free = share * sum(sizes), {}, set(range(len(sizes)))
        while free:
            level = (total - sum(out.values())) / sum(weights[i] for i in free)
            over = {i for i in free if level * weights[i] > 2 * sizes[i]}
            if not over:
                return {**out, **{i: level * weights[i] for i in free}}
            out |= {i: 2.0 * sizes[i] for i in over}
            free -= over
        return out

    rng = random.Random(4)
    for _ in range(3):
        sizes = [rng.choice([0, 5, 100, 2000]) for _ in range(7)]
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        want = brute(sizes, [(3, 1, 2)[i % 3] for i in range(7)], 1.5)
        for r in mixing.targets(df).collect():
            assert r.target == pytest.approx(want[int(r.source[1:])], abs=1e-6)


def test_mix_is_near_its_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 20 + 1).cast("int")), " ").alias("text"))
    for r in mixing.mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r.t - r.n) <= 20


def test_slots_fill_sequences():
    rng = random.Random(7)
    for _ in range(20):
        counts = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(1, 20))}
        used, got = defaultdict(list), defaultdict(int)
        for length, a, b, first, each, at in packing.plan_slots(counts, 64):
            assert got[length] == a
            got[length] = b
            for rank in range(a, b):
                used[first + (rank - a) // each].append((at + (rank - a) % each * length, length))
        assert dict(got) == counts
        for spans in used.values():
            end = 0
            for start, length in sorted(spans):
                assert start == end
                end += length
            assert end <= 64
        # best fit one by one needs as many
        rooms = []
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                fit = 64
            else:
                rooms.remove(fit)
            rooms.append(fit - length)
        assert len(used) == len(rooms)


def test_packing_equals_the_tokenizer(spark, odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(common.default_tokenizer())
    capacity = 64
    got = packing.packed(odd_docs, capacity=capacity, with_ids=True).collect()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, k, s, zlib.crc32(array("I", ids[s : s + capacity]).tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    key = lambda x: (x[0] is not None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    assert packing.packed(no_docs).count() == 0
    seq = packing.sequences(packing.packed(odd_docs.where("doc_id in (1, 2)"), capacity=capacity, with_ids=True))
    assert sum(len(r.ids) for r in seq.collect()) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in odd_docs.where("doc_id in (1, 2)").collect())


def test_ranks_of_crowded_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 7)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a cat").alias("text"))
    got = packing.packed(docs, capacity=8).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 200 and len({r.sequence_id for r in got}) == 100


def test_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(common.default_tokenizer())
    own = common.WordEncoder(common.default_tokenizer(), most=50)
    rng = random.Random(2)
    texts = ["it's don't 'S x'sun !'s a_b ab12c ²³ a² ½", "<|endoftext|> <|ENDOFTEXT|>", "É́a Σας İx", "a\tb!\t's\x1c\x85\xa0q", "", " \n ", "''''s --'t", "\0a\0 b"]
    texts += ["".join(rng.choice("aB's_1²é É<|>\n\t.,!\0Σ\xa0ßÿ×÷") for _ in range(30)) for _ in range(500)]
    for t in texts:
        assert list(array("I", own.ids(t))) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def brute_fingerprint(text, k):
    from xxhash import xxh64_intdigest

    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else [" ".join(ws)] if ws else []
    hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """prints: list of (doc_id, value); the smallest id reachable for each."""
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(prints))]


def test_fingerprints_equal_brute_force(odd_docs):
    for t in ["a", "a b", "A B c", "x y z w", "É a\tb\x0bc", "a b c " * 50, None, ""]:
        assert simhash.fingerprint(t) == brute_fingerprint(t, 3)
    assert simhash.fingerprint("p q r s t u v w " * 40, at_once=7) == brute_fingerprint("p q r s t u v w " * 40, 3)


def test_near_duplicates_equal_brute_force(spark, odd_docs, no_docs):
    docs = odd_docs
    data = [(r.doc_id, brute_fingerprint(r.text, 3)) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((d, f"{v:016x}", c) for (d, v), c in zip(data, brute_components(data))), key=str)
    got = simhash.near_duplicates(docs).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_reach_whatever_is_within_two_bits(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:30]:  # chains of near values
        for _ in range(4):
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                v ^= 1 << rng.randrange(64)
            values.add(v)
    center = rng.getrandbits(64)
    values |= {center} | {center ^ (1 << b) for b in range(64)}
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components([(i, v) for i, v in enumerate(values)])
    groups, ours = defaultdict(set), defaultdict(set)
    for (s,), c in zip(signed, want):
        groups[c].add(s)
        ours[found.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_bk_tree_equals_brute_force():
    rng = random.Random(9)
    values = list({rng.getrandbits(10) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.values[i] for i in tree.find(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(500, 400)], "u long, v long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(101)} | {(500, 400), (400, 400)}
    assert simhash.components(edges.where("false")).count() == 0


def test_one_document_of_a_group_stays(odd_docs, no_docs):
    out = simhash.keep_first(odd_docs)
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert out.columns == odd_docs.columns and 2 not in ids and {1, 6, 7, 9, 11} <= set(ids) and len(ids) == len(set(ids))
    assert simhash.keep_first(no_docs).count() == 0


def shingles5(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts, near = [], []
    for _ in range(40):  # pairs of likeness between 0.8 and 1, and just below 0.8
        base = fresh(200)
        for changes in (2, 4):
            other = list(base)
            for k in range(changes):
                other[20 + 40 * k] = "changed"
            near.append((len(texts), len(texts) + 1, changes))
            texts += [base + [str(changes)], other + [str(changes)]]
            base = fresh(200)
        other = list(base)
        for k in range(6):
            other[10 + 30 * k] = "changed"
        texts += [base, other]
    long = fresh(260)
    texts += [long[10 * k : 10 * k + 200] for k in range(6)]  # each near the next and not the last
    texts = [" ".join(t) for t in texts]
    sets = [shingles5(t) for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if like(i, j) >= 0.8:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    assert all(0.8 <= like(i, j) < 1 for i, j, _ in near)
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {i for i in range(len(texts)) if top(i) == i} and len(kept) < len(texts) - 70


def crowd_of_near_misses():
    """A text, 150 near it and 150 just too far from it and from them."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(300):
        other = list(base)
        for place in rng.sample(range(5, 295), 7 if k % 2 else 2):
            other[place] = f"new{rng.getrandbits(40)}"
        texts.append(" ".join(other))
    return texts


def firsts_of(texts):
    """Of each component of near copies the first, by brute force."""
    sets = [shingles5(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i for i in range(len(texts)) if top(i) == i}


def test_sets_still_apart_need_no_pairs(spark, monkeypatch):
    texts, compared, near = crowd_of_near_misses(), [], simhash._near
    monkeypatch.setattr(simhash, "_near", lambda docs, classes, pairs, shingle: compared.append(pairs.count()) or near(docs, classes, pairs, shingle))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == firsts_of(texts) and 100 < len(kept) < 160
    assert sum(compared) < 20 * len(texts)  # whole sets are compared for a few pairs of each text, not for all that might be near


def test_large_shards_are_not_dealt_to_each_part_whole(spark, monkeypatch):
    texts, dealt, frame = crowd_of_near_misses()[1::2] + crowd_of_near_misses()[:40:2], [], type(spark.range(0))  # most are near
    repartition = frame.repartition
    monkeypatch.setattr(simhash, "HOT_SHARD", 10)
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: ("part" in cols and dealt.append((self.count(), self.select("key", "set").distinct().count()))) or repartition(self, n, *cols))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == firsts_of(texts)
    (first, members), (rest, still) = dealt
    assert first == members and still < rest < 2 * still  # shards have up to 17 parts


@pytest.mark.parametrize("head", [0, 8, 200])
def test_joins_of_a_shard_equal_brute_force(head):
    import numpy as np

    rng = random.Random(22)
    base = [rng.getrandbits(63) for _ in range(120)]
    sets = [set(base)]
    for k in range(80):  # from near to far, some near each other by the same changes
        start = sets[rng.randrange(len(sets))] if k % 3 else sets[0]
        sets.append(set(rng.sample(sorted(start), len(start) - rng.randrange(15))) | {rng.getrandbits(63) for _ in range(rng.randrange(15))})
    against = (sets + [{rng.getrandbits(63) for _ in range(50)}] * 200)[head]
    members = []
    for i, s in enumerate(sets):
        fp, bits, _ = simhash.sketch(np.array(sorted(s), "<u8"))
        members.append((i, len(s), fp, int.from_bytes(bits, "little"), True, i if i % 4 else 0, 0, len(against - s), np.array(sorted(against ^ s), "<u8")))
    like = lambda a, b: len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4

    def grouped(links):
        parent = list(range(len(sets)))

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in [*links, *((i, 0) for i in range(0, len(sets), 4))]:  # those of the main component are joined already
            parent[max(top(a), top(b))] = min(top(a), top(b))
        return [top(i) for i in range(len(sets))]

    links = simhash.shard_joins(members)
    reach = [(a, b) for a in range(len(sets)) for b in range(a) if (members[a][2] ^ members[b][2]).bit_count() <= simhash.NEAR_RADIUS and simhash._alike(members[a], members[b]) is not None]
    assert all(u > v and like(u, v) for u, v in links) and grouped(links) == grouped([(a, b) for a, b in reach if like(a, b)])
    assert len(links) == len({m[5] for m in members}) - len(set(grouped(links))) and 10 < len(links) < len(reach)


def test_clean_texts_that_share_an_id_stay(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(4))
    data = [(None, a), (None, b), (None, b), (None, b + " more"), (7, c), (7, d), (7, d), (3, c + " more")]
    kept = simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    texts = sorted((r.text for r in kept), key=[a, b, b + " more", c + " more", d].index)
    assert len(kept) == 4 and texts[0] == a and texts[1] in (b, b + " more") and texts[2:] == [c + " more", d]
    assert sorted((r.doc_id for r in kept), key=str) == [3, 7, None, None]


def brute_signatures(text):
    """Spot signatures by their definition, word by word."""
    from xxhash import xxh32_intdigest

    bare = [w for w in (raw.strip(spotsigs.EDGES) for raw in (text or "").lower().split()) if w]
    found = set()
    for i, w in enumerate(bare):
        chain = [x for x in bare[i + 1 :] if x not in spotsigs.ANCHORS][:2] if w in spotsigs.ANCHORS else []
        if len(chain) == 2:
            found.add(xxh32_intdigest(" ".join([w, *chain])))
    if not found:
        found = {xxh32_intdigest(" ".join(bare[i : i + 3])) for i in range(len(bare) - 2)} or ({xxh32_intdigest(" ".join(bare))} if bare else set())
    return found


def brute_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_bitmaps_lose_nothing(spark, monkeypatch):
    rng = random.Random(13)
    sought = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    keys = spark.createDataFrame([(k,) for k in sought], "k long")
    others = spark.createDataFrame([(rng.randrange(-(1 << 63), 1 << 63),) for _ in range(3000)] + [(None,)], "k long")
    for words, most in ((1 << 20, 30), (4, 3001)):  # a full bitmap parts nothing
        monkeypatch.setattr(common, "BITMAP_WORDS", words)
        bits = common.bitmap(keys, "t")
        assert bits.count() <= words
        assert common.with_likely(keys, F.col("k"), bits).where("not _likely").count() == 0
        assert common.with_likely(others, F.col("k"), bits).where("_likely").count() <= most
    assert common.with_likely(others, F.col("k"), common.bitmap(keys.where("false"), "t")).where("_likely").count() == 0


def brute_followers(docs):
    from xxhash import xxh64_intdigest

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxh64_intdigest(r[1].encode(), 42)), r[1]), reverse=True)
    return [(*a, order[(i + 1) % len(order)][1]) for i, a in enumerate(order)]


def test_spot_fingerprints_equal_brute_force(spark, odd_docs, no_docs):
    want, known = [], {}
    sigs = lambda t: known.setdefault(t, brute_signatures(t if len(t) < 100_000 else t[:2000]))  # noqa: E731  the long text repeats itself
    hexed = lambda s: "".join(f"{x:08x}" for x in sorted(s))
    for d, t, after in brute_followers([(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()]):
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        other = sigs(changed) if d != 6 else None
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), hexed(sigs(t)), other and hexed(other), None if other is None else brute_jaccard(sigs(t), other), brute_jaccard(sigs(t), sigs(after))))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint if r.doc_id != 6 else None, r.near_edited if r.doc_id != 6 else None, r.near_next) for r in spotsigs.fingerprints(odd_docs).collect()]
    assert sorted(got, key=str) == sorted(((*w[:4], w[4] if w[0] == 6 or w[4] is not None else "", *w[5:]) if w[0] == 6 else (*w[:4], w[4] or "", *w[5:]) for w in want), key=str)
    assert spotsigs.fingerprints(no_docs).count() == 0


def test_rows_of_one_id_are_parted(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_A_TASK", 5)
    rng = random.Random(2)
    data = [(None if i % 3 else 7, f"the {rng.random()} cat of x{i} and y") for i in range(90)] + [(i, "same text") for i in range(4)] + [(7, "copy")] * 20
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    held = spotsigs.with_following(docs).where("not last").groupBy("part").count().collect()
    assert len(held) > 8 and max(r["count"] for r in held) <= 30
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in spotsigs.fingerprints(docs).collect())
    assert got == sorted((str(d), len(t), hashlib.sha256(spotsigs.edited(t, after).encode()).hexdigest()) for d, t, after in brute_followers(data))


@pytest.mark.parametrize("ranges", [20_000, 3])
def test_followers_across_partitions(spark, monkeypatch, ranges):
    monkeypatch.setattr(spotsigs, "ROWS_A_TASK", 5)
    monkeypatch.setattr(spotsigs, "MOST_RANGES", ranges)
    rng = random.Random(1)
    data = [(i * 7, f"the {rng.random()} cat of x{i} and y") for i in range(120)]
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.fingerprints(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()}
    for d, t, after in brute_followers(data):
        assert got[d] == hashlib.sha256(spotsigs.edited(t, after).encode()).hexdigest()


def test_spot_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    base = [f"the {rng.choice('abcdefghij')}{i} word{i} " for i in range(40)]
    texts = ["".join(base), "".join(base[:38]), "".join(base[:30]), "".join(base), "".join(base[2:]) + "of new thing", "unrelated the one two of three four", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [brute_signatures(t) for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[a] != sets[b] and a != 3 and b != 3 and spotsigs.likeness(sets[a], sets[b]) >= 0.8}
    got = spotsigs.near_pairs(docs).collect()
    assert want and {(min(r.first_a, r.first_b), max(r.first_a, r.first_b)) for r in got} == want and len(got) == len(want)
    assert all(r.likeness == pytest.approx(brute_jaccard(sets[r.first_a], sets[r.first_b])) and r.a < r.b for r in got)
    assert spotsigs.near_pairs(docs.where("false")).count() == 0
    unnamed = spotsigs.near_pairs(docs.selectExpr("cast(null as bigint) as doc_id", "text")).collect()
    assert len(unnamed) == len(want) and {r.first_a for r in unnamed} == {None}
    for _ in range(300):
        a, b = (sorted(rng.sample(range(12), rng.randint(0, 9))) for _ in range(2))
        exact = spotsigs.likeness(set(a), set(b))
        assert spotsigs.pruned_likeness(a, b, 0.5) == (pytest.approx(exact) if exact >= 0.5 else None)


def test_counts_under_edits_equal_full_encoding(odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(common.default_tokenizer())
    full = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    for trial in range(40):
        text = "".join(rng.choice(["word ", "it's ", "\n", "x", "9", "!", " ", "été "]) for _ in range(rng.randint(0, 200)))
        tree = token_counts.TokenTree(text, full, leaf=rng.choice([1, 3, 64]))
        for _ in range(12):
            a, b = sorted(rng.randint(0, len(text) + 3) for _ in range(2))
            new = rng.choice(["", " ", "abc", "\nnew line", "'s", "1 2"])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == full(text)
    texts = {r.doc_id: r.text or "" for r in odd_docs.select("doc_id", "text").collect()}
    got = token_counts.counts(odd_docs).collect()
    assert len(got) == odd_docs.count()
    todo = defaultdict(set)
    for r in token_counts.sample_edits(odd_docs).collect():
        todo[r.doc_id].add((r.seq, r.start, r.stop, r.new))
    for r in got:
        text = texts[r.doc_id]
        assert r.n_tokens == full(text) and r.n_edits == 3
        for _, a, b, new in sorted(todo[r.doc_id]):
            text = text[:a] + new + text[b:]
        assert r.edited_n_tokens == full(text)
        assert r.reencoded_chars < 5000 or len(text) < 5000
    assert token_counts.counts(no_docs).count() == 0


def test_leaves_between_pre_tokens():
    """Texts without white space have many leaves, cut only where the tokenizer's counts add up."""
    tokenizer = Tokenizer.from_file(common.default_tokenizer())
    full = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(8)
    alphabet = ["日本語", "。", "、", "a", "B9", "<|endoftext|>", "<|", "endoftext", "|>", "'", "s", "'RE", "e", "\u0301", "İ", ".", "()", "{x:1}", "ſ", "\u1100", "\u1161", "\u0958", "=", "_", "\U0001f600"]
    for trial in range(60):
        odd = trial % 2
        letters = alphabet if odd else [x for x in alphabet if x not in ("\u0301", "İ", "\u0958", "\u1100")]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(400, 900)))
        tree = token_counts.TokenTree(text, full, leaf=rng.choice([2, 16]))
        assert (odd or len(tree.leaves) > 5) and tree.total == full(text)
        for _ in range(6):
            a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
            b, new = min(b, a + 6), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 3)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == full(text)
        again = token_counts.TokenTree.kept(text, *tree.stored(), full)
        assert again.total == tree.total and again.text == text
    code = "f(x)=g[i]+h{j};" * 4000
    tree = token_counts.TokenTree(code, full)
    tree.edit(30_000, 30_003, "new(")
    assert tree.reencoded < 1000 and tree.total == full(tree.text)


def test_kept_trees_serve_later_edits(spark):
    """Only edited documents are read again, and new trees serve the next edits."""
    tokenizer = Tokenizer.from_file(common.default_tokenizer())
    full = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    data = [(1, "a b c " * 100), (2, "not edited"), (None, "no id here"), (4, None), (5, "twice"), (5, "twice"), (5, "third text")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("todo", F.lit(1))
    kept = common.stored(token_counts.trees(docs), "t")
    edits = spark.createDataFrame([(1, 0, 4, 7, "new words"), (1, 1, 0, 2, ""), (None, 0, 999, 999, " end"), (4, 0, 0, 0, "born"), (5, 0, 0, 1, "T"), (9, 0, 0, 0, "nobody")], "doc_id long, seq int, start int, stop int, new string")
    got = common.stored(token_counts.apply_edits(docs, kept, edits, with_text=True), "t").orderBy("doc_id", "text")
    first = data[0][1][:4] + "new words" + data[0][1][7:]
    want = [(None, "no id here end"), (1, first[2:]), (4, "born"), (5, "Third text"), (5, "Twice"), (5, "Twice")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.edited_n_tokens == full(r.text) for r in got.collect()) and all(r.n_tokens == full(t or "") for r in kept.join(docs.select("doc_id", "text"), "doc_id").where("doc_id < 5").collect() for t in [r.text])
    again = token_counts.apply_edits(got.select("doc_id", "text"), got, edits.where("doc_id = 1"))
    assert again.count() == 1 and again.first().n_tokens == full(first[2:])
    assert token_counts.apply_edits(docs, kept, edits.where("false")).count() == 0


def odd_pages(spark):
    data = [(1, "http://a/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a/\r\nx", None), (None, "http://b", "y"), (5, "http://c", ""), (5, "http://c", ""), (6, "http://d", "WARC/1.1\r\n\r\n" * 3), (7, "http://e", "z" * 3_000_000)]
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'x' as _sha1", "1 as record_type").repartition(3)


@pytest.mark.parametrize("least", [0, 1])
def test_archives_round_trip(spark, least):
    pages = odd_pages(spark)
    data = [(r.page_id, r.html or "") for r in pages.select("page_id", "html").collect()]
    want = []
    for page, html in data:
        raw = html.encode()
        last = max((p for p, h in data if h == html and p is not None), default=None)
        shared = sum(h == html for _, h in data) > 1 and len(raw) >= least
        revisit = shared and page != last
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    got = warc.round_trip(pages, least).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_records_have_names_of_their_own(spark, tmp_path):
    pages = odd_pages(spark).unionByName(odd_pages(spark).where("page_id = 1"))
    long = "http://e/" + "u" * 300_000 + "?\u0416 x"
    pages = pages.unionByName(pages.where("page_id = 7").selectExpr("cast(8 as bigint) as page_id", f"'{long}' as url", "html", "_sha1", "record_type"))
    folder = f"file://{tmp_path}/run/monolithic"
    written = common.stored(warc.write_archives(warc.records(pages), folder), "t")
    names, to = [], []
    for r in written.collect():
        raw = gzip.decompress((tmp_path / "run" / "monolithic" / r.archive).read_bytes())
        names += re.findall(rb"\r\nWARC-Record-ID: <(.*?)>\r\n", raw)
        to += re.findall(rb"\r\nWARC-Refers-To: <(.*?)>\r\n", raw)
    assert len(names) == len(set(names)) == pages.count() and to and set(to) <= set(names)
    back = {r.page_id: r.url for r in warc.round_trip(pages).collect()}
    assert back[8] == "http://e/" + "u" * 300_000 + "?\u0416%20x"


def test_normaliser_makes_members():
    parts = [warc.record_bytes(i, f"http://x/{i}", "h" * (i * 700_000), "D", "response", None, None, None, str(i)) for i in range(4)]
    out = io.BytesIO()
    index = warc.normalise_stream(io.BytesIO(gzip.compress(b"".join(parts))), out)
    assert [zlib.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == parts
    assert [e["page"] for e in index] == ["0", "1", "2", "3"] and gzip.decompress(out.getvalue()) == b"".join(parts)
    with pytest.raises(ValueError):
        warc.normalise_stream(io.BytesIO(gzip.compress(parts[1][:300])), io.BytesIO())


def test_pipeline_stages(spark, odd_docs, tmp_path):
    """Stages over nulls, repeats, long texts and clashing columns."""
    import corpus_pipeline

    docs = common.stored(odd_docs, "t")
    columns, seen = docs.columns, [docs.count()]
    assert {"_w", "shard", "h", "first", "size"} <= set(columns)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert seen[0] > seen[1] >= seen[2] > seen[3] > 0 and seen[-1] > 0
    empty = odd_docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_scratch_of_a_run_is_removed(spark, odd_docs, tmp_path):
    import os

    import corpus_pipeline

    odd_docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{common.scratch_root(spark)}/pagelode".removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and "best_fit_packing" in left.pop() and out.count() > 0


def brute_pipeline(docs):
    """(doc_id, copies) of what the first four stages keep, and the sizes by source."""
    from test_cleaning import brute_measures

    kept = []
    for d, t, *rest in docs:
        n, chars, symbols, dup_lines, repeats = brute_measures(t)
        lines = [x for x in t.split("\n") if x.strip()]
        stutters = sum(a == b for a, b in zip(words(t), words(t)[1:]))
        digits, cut = sum(c in "0123456789" for c in t), sum(x.endswith(("...", "…")) for x in lines)
        bad = n < 10 or 100 * repeats > 20 * n or 10 * symbols > n or not 2 * n <= chars <= 20 * n or 2 * dup_lines > len(lines) or 2 * digits > chars or 10 * cut > 3 * len(lines) or 10 * stutters > 3 * n
        if not bad:
            kept.append((d, t, *rest))
    first = []
    for d, t, *rest in sorted(kept):
        mine = shingles5(t)
        if all(len(mine & s) < 0.8 * len(mine | s) for *_, s in first):
            first.append((d, t, *rest, mine))
    return [x[:-1] for x in first]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every document that the rules keep and that copies no earlier one is packed, as often as its source's target asks, with the tokenizer's length."""
    import corpus_pipeline

    rng = random.Random(6)
    vocabulary = [a + b for a in ("the", "and", "of", "cat", "dog", "run") for b in ("", "s", "er", "ing", "ly")]
    docs, fresh = [], lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    for i in range(60):
        docs.append((i, fresh(80), "en", f"s{i % 3}"))
    near = docs[4][1].split()
    near[10] = "changed"
    docs += [(100, docs[0][1], "en", "s0"), (101, "## ** $$ " * 30, "en", "s1"), (102, "too short", "en", "s1"), (103, " ".join(near), "en", "s2"), (104, fresh(40) + "\n" + fresh(40), "en", "s2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = brute_pipeline(docs)
    assert {r[0] for r in kept} == {*range(60), 104}
    tokenizer = Tokenizer.from_file(common.default_tokenizer())
    size = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t, *_ in docs}
    assert all(r.length == size[r.doc_id] and r.start == 0 for r in got)
    copies = defaultdict(int)
    for r in got:
        copies[r.doc_id] += 1
    sizes = {s: sum(len(words(t)) for _, t, _, source in kept if source == s) for s in ("s0", "s1", "s2")}
    total, weights = 1.5 * sum(sizes.values()), {"s0": 3, "s1": 1, "s2": 2}
    target = {s: total * w / 6 for s, w in weights.items()}
    target["s0"] = min(target["s0"], 2.0 * sizes["s0"])
    rest = total - target["s0"]
    target |= {"s1": rest / 3, "s2": 2 * rest / 3}
    assert target["s1"] < 2 * sizes["s1"] and target["s2"] < 2 * sizes["s2"]
    for s in sizes:
        mine = [(copies[d], len(words(t))) for d, t, _, source in kept if source == s]
        base = int(target[s] // sizes[s])
        assert {c for c, _ in mine} <= {base, base + 1}
        assert abs(sum(c * n for c, n in mine) - target[s]) <= 41
    assert {d for d, c in copies.items() if c} <= {r[0] for r in kept}
    room = defaultdict(int)
    for r in got:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 1
