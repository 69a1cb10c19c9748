"""Best-fit packing by length-histogram planning.

Whole texts are encoded and cut into pieces of at most ``capacity`` tokens. The
plan is made from the number of pieces of each length alone, which is at most
``capacity`` numbers whatever the corpus: lengths in falling order go to the
open sequences with the least room that is enough, and whole runs of equal
sequences are filled at once, so the plan is a short table of slot runs. Pieces
then take slots by their rank within their length. A crowded length is ranked
in chunks of about ``CHUNK`` pieces by a hash of the piece and of where it was made,
so no task ranks a whole length, nor all the pieces of a repeated id or text.

Defined cases: a null text counts as an empty one and gives the final id alone;
rows that share a doc_id are packed each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.llm.common import default_tokenizer, encoder, small_batches, stored, texts_in

CAPACITY = 2048
CHUNK = 1000
#: Up to so many runs the plan is broadcast (about 6 MB).
MOST_RUNS = 100_000
END_ID = 0


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces a sequence, offset of its first) of best-fit decreasing.

    Piece ``rank`` of a run lies in sequence ``first + (rank - first rank) // k``
    at ``offset + (rank - first rank) % k * length``.
    """
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots, fresh = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room = capacity
                first, count = fresh, -(-(n - rank) // (capacity // length))
                fresh += count
            each = room // length
            full = min(count, (n - rank) // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, first, count = rank + full * each, first + full, count - full
            if rank < n and count:
                slots.append((length, rank, n, first, n - rank, capacity - room))
                put(room - (n - rank) * length, first, 1)
                rank, first, count = n, first + 1, count - 1
            put(room, first, count)
    return slots


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt (a number of the row within its task), and the ids themselves if asked for."""
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, salt long" + ", ids array<long>" * with_ids

    def run(batches: Iterator) -> Iterator:
        from zlib import crc32

        import numpy as np
        import pyarrow as pa

        end, width, own, salt = END_ID.to_bytes(4, "little"), 4 * capacity, encoder(path), 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for begin, texts in texts_in(batch, "text"):
                out: list[list] = [[] for _ in range(6 + with_ids)]
                for key, text in zip(keys[begin:], texts):
                    ids = own.ids(text or "") + end
                    for k, start in enumerate(range(0, len(ids), width)):
                        part = ids[start : start + width]
                        for column, value in zip(out, (key, k, start // 4, len(part) // 4, crc32(part), salt)):
                            column.append(value)
                        salt += 1
                        if with_ids:
                            out[6].append(np.frombuffer(part, "<u4").astype("<i8"))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"][: len(out)])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (stored pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    chunks = [1] + [-(-counts.get(k, 0) // CHUNK) or 1 for k in range(1, capacity + 1)]
    of = F.when(F.lit(max(chunks) > 1), F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.get(F.array(*map(F.lit, chunks)), F.col("length")))).otherwise(0).cast("long")
    dealt = cut.withColumn("_chunk", of)
    sums = dealt.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    bases = stored(
        sums.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n"), "pack-bases"
    )
    inside = F.row_number().over(W.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32", "salt"))
    ranked = dealt.withColumn("_in", inside).join(bases, ["length", "_chunk"]).withColumn("_rank", F.col("_base") + F.col("_in") - 1)
    plan = plan_slots(counts, capacity)
    slots = spark.createDataFrame(plan, "_length int, _from long, _to long, _first long, _each long, _at long")
    # Its rows depend on the plan over at most `capacity` lengths, not on the corpus.
    got = ranked.join(F.broadcast(slots) if len(plan) <= MOST_RUNS else slots, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    into = F.col("_rank") - F.col("_from")
    return got.select(
        *[c for c in cut.columns if c != "salt"],
        (F.col("_first") + F.floor(into / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(into, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    ).withColumn("length", F.col("length").cast("long"))


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece with its place; ``with_ids`` adds the ids."""
    return place(stored(pieces(docs, tokenizer, capacity, with_ids), "pack-pieces"), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from ``packed(..., with_ids=True)``. A sequence holds at most its capacity."""
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
