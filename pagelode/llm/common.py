"""What several operators of this subpackage share: scratch tables, words, cached tokenisation."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as characters and as a Java character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \t\n\x0B\f\r]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagelode-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Where scratch tables go just now, if not to the root's own folder.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_FOLDER.get() or scratch_root(spark) + '/pagelode'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for the scratch tables made within, which are removed at the end: results must be written elsewhere before."""
    path = scratch_path(spark, name)
    before = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(before)
        remove(spark, path)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared scratch folder (or to path) and read back: lineage is cut, and its measured size decides whether joins broadcast it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this library; results that still read them are lost."""
    remove(spark, f"{scratch_root(spark)}/pagelode")


#: Words of 64 bits in a bitmap: it is broadcast, whatever the number of its keys.
BITMAP_WORDS = 1 << 20


def _cell(key: Column) -> tuple[Column, Column]:
    """(word, bit) of a key."""
    h = F.xxhash64(key, F.lit(7))
    return h.bitwiseAND(F.lit(BITMAP_WORDS - 1)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")


def bitmap(keys: DataFrame, name: str) -> DataFrame:
    """word, bits: a bitmap of the hashes of keys (one long column), at most ``BITMAP_WORDS`` rows. With some hundred millions of keys it is full and parts nothing any more."""
    word, bit = _cell(F.col(keys.columns[0]))
    one = F.expr("1L")
    return stored(keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit"))).alias("bits")), name)


def with_likely(df: DataFrame, key: Column, bits: DataFrame, name: str = "_likely") -> DataFrame:
    """df with a flag: false only where key is surely not in the bitmap. So what is not sought need not be shuffled."""
    word, bit = _cell(key)
    held = bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    marked = df.withColumn("_at", word).withColumn("_bit", bit).join(F.broadcast(held), F.col("_at") == F.col("_word"), "left")
    found = F.call_function("shiftrightunsigned", F.coalesce("_bits", F.lit(0).cast("long")), F.col("_bit")).bitwiseAND(F.lit(1).cast("long")) == 1
    return marked.withColumn(name, found).drop("_at", "_bit", "_word", "_bits")


def words_of(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; null and blank texts give an empty array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS)).otherwise(F.array().cast("array<string>"))


def small_batches(df: DataFrame, rows: int = 1000, size: str = "16m") -> DataFrame:
    """df, after limiting the session's Arrow batches (unless they are smaller already), so that long texts do not fill the Python workers' memory."""
    conf = df.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def texts_in(batch, column: str, at_once: int = 256) -> Iterator[tuple[int, list]]:
    """Slices of a record batch's text column as Python strings, so that few are alive at a time."""
    values = batch.column(column)
    for start in range(0, len(values), at_once):
        yield start, values.slice(start, at_once).to_pylist()


#: Bytes of Latin-1 texts that the quick way takes: no control characters and no white space but space and line feed.
_QUICK = bytes([10, *range(0x20, 0x7F), *range(0xA1, 0x100)])
_LOWER = bytes(ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256))
_LETTER = b"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = b"0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_PARTS = re.compile(b"[" + _LETTER + b"]+|'(?:s|t|re|ve|m|ll|d)|[^ \n" + _LETTER + _NUMBER + b"]+|[" + _NUMBER + b"]")


class WordEncoder:
    """Token ids of texts under a lower-casing tokenizer whose tokens cross no white space.

    A text is cut into parts that the tokenizer would encode apart: Latin-1
    texts, once lower-cased, into the tokenizer's own pre-tokens; others, and
    those with control characters or the look of a special token, at spaces and
    line feeds only. The ids of each part are kept as little-endian unsigned
    32-bit bytes in two generations of at most ``most`` parts, so memory is
    bounded and frequent parts stay; new parts are encoded by the tokenizer.
    """

    def __init__(self, path: str, most: int = 250_000):
        import os
        from array import array

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.array, self.tokenizer, self.most = array, Tokenizer.from_file(path), most
        self.cache: dict = {}
        self.old: dict = {}

    @staticmethod
    def parts(text: str) -> list:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"\0"
        if raw.translate(None, _QUICK) or b"<|" in raw:
            return text.replace("\n", " ").split(" ")
        return _PARTS.findall(raw.translate(_LOWER))

    def learn(self, parts: list) -> None:
        """Put the ids of all parts into the young generation."""
        new = set(parts).difference(self.cache)
        if not new:
            return
        if len(self.cache) + len(new) > self.most:
            self.old, self.cache = self.cache, {}
            new = set(parts)
        unknown = []
        for part in new:
            if part in self.old:
                self.cache[part] = self.old[part]
            else:
                unknown.append(part)
        texts = [p if isinstance(p, str) else p.decode("latin-1") for p in unknown]
        for part, found in zip(unknown, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            self.cache[part] = self.array("I", found.ids).tobytes()

    def ids(self, text: str) -> bytes:
        parts = self.parts(text)
        self.learn(parts)
        return b"".join(map(self.cache.__getitem__, parts))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
