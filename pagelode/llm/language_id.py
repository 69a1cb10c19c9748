"""Language identification by string kernels.

The kernel of two texts is the mean, over n = 1, 2, 3, of the number of n-grams
present in both divided by the root of the product of how many each has.
Letters are lower-cased and hashed to an alphabet of 63; all else is one blank.
Landmark texts give a Nystroem map, on which kernel ridge regression learns one
language against the rest. A batch of texts becomes a matrix of n-gram presences over
the landmarks' n-grams; scores are two matrix products.

Every language with a labelled row is learned. The model is fitted on a sample
of at most ``FIT_ROWS`` labelled rows: each language has an equal part of it, but
``PER_LANG`` at most, taken by a hash of doc_id below a threshold set from the
language's count. (``FIT_ROWS`` is above the number of living languages, so each
has its row; labels beyond that number could have none.) The rows' n-grams
together are at most ``SAMPLE_GRAMS``, those of the landmarks ``MARK_GRAMS``:
where texts are very long, each language gives fewer of them. The landmarks'
matrix is kept sparse and made dense only where it is small. Training rows are
those whose crc32 of doc_id (as text) modulo 4 is not 2. Predictions see whole
texts and nothing else.

Scores of one-versus-rest regression add up to 1, so the best of K is never below
1/K; ``keep_known`` judges by how much of the way from there to 1 it has gone, so
that texts in two learned languages stay and the number of languages does not count.

Defined cases: a null text, one without letters (of any plane), and any text
where nothing could be learned get ``und`` and score 0; rows with null lang are
not learned from; of equal scores the first language by name wins; repeated rows
are predicted alike; an empty table gives an empty result; ``identify`` ignores
further columns, whatever their names, and ``keep_known`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.llm.common import small_batches, stored, texts_in

#: Labelled rows of all languages together, and of one.
FIT_ROWS, PER_LANG = 20_000, 400
#: Landmarks of all languages together, and of one.
LANDMARKS, LANDMARKS_PER_LANG = 1024, 32
SAMPLE_GRAMS, MARK_GRAMS = 64_000_000, 8_000_000
#: Up to so many cells the landmarks' matrix is dense.
DENSE_CELLS = 16_000_000
#: The least excess over an even share of a known language; held-out documents in one or two languages have 0.2 and more.
LEAST_EXCESS = 0.15
SIDE = 64
STARTS = (0, SIDE, SIDE + SIDE**2)
SPACE = SIDE + SIDE**2 + SIDE**3


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@cache
def _letters():
    """The alphabet's letter of each code point; 0 for what is no letter."""
    import numpy as np

    points = np.flatnonzero(np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000))
    table = np.zeros(0x110000, np.uint8)
    table[points] = np.where((points >= 97) & (points <= 122), points - 96, 27 + (points * 40503 >> 5) % 37)
    return table


class Spectrum:
    """Which n-grams a text has; one buffer serves all texts."""

    def __init__(self) -> None:
        import numpy as np

        self.np, self.seen = np, np.zeros(SPACE, bool)

    def __call__(self, text: str | None, at_once: int = 1 << 20):
        """Sorted n-gram numbers, or None if the text has no letter."""
        np, letters, some = self.np, _letters(), False
        text = (text or "").lower()
        for start in range(0, len(text), at_once):
            points = np.frombuffer(text[start : start + at_once + 2].encode("utf-32-le", "surrogatepass"), "<u4")
            a = letters[points].astype(np.int32)
            some = some or bool(a.any())
            self.seen[a] = True
            two = a[:-1] * SIDE + a[1:]
            self.seen[STARTS[1] + two] = True
            self.seen[STARTS[2] + two[:-1] * SIDE + a[2:]] = True
        self.seen[[0, STARTS[1], STARTS[2]]] = False  # of blanks alone
        grams = np.flatnonzero(self.seen)
        self.seen[grams] = False
        return grams if some else None


def spectrum_weights(grams):
    """For each n-gram 1/sqrt(3 x how many of its n the text has)."""
    import numpy as np

    cuts = np.searchsorted(grams, STARTS[1:])
    sizes = np.diff([0, *cuts, len(grams)])
    return np.repeat(1 / np.sqrt(3.0 * np.maximum(sizes, 1)), sizes).astype(np.float32)


class KernelModel:
    """Landmarks as sparse rows by n-gram, and the weights and bias of each language.

    ``starts`` has, for each of the ``SPACE`` n-grams, where its cells begin in
    ``which`` (a landmark) and ``held`` (the n-gram's weight there).
    """

    def __init__(self, langs: list[str], marks: list):
        import numpy as np

        self.langs, self.n = langs, len(marks)
        grams = np.concatenate([np.empty(0, np.int64), *marks])
        order = np.argsort(grams, kind="stable")
        self.which = np.repeat(np.arange(self.n, dtype=np.int32), [len(g) for g in marks])[order]
        self.held = np.concatenate([np.empty(0, np.float32), *map(spectrum_weights, marks)]).astype(np.float32)[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(grams, minlength=SPACE))]).astype(np.int32)
        self.weights = self.bias = self.place = self.marks = None

    def size(self) -> int:
        """Bytes of what is sent to executors."""
        return sum(a.nbytes for a in (self.which, self.held, self.starts, self.weights, self.bias))

    def __getstate__(self):
        return self.__dict__ | {"place": None, "marks": None}

    def _dense(self) -> bool:
        """Make the matrix of the landmarks' own n-grams x landmarks, if it is small."""
        import numpy as np

        if self.place is None:
            used = np.flatnonzero(np.diff(self.starts))
            self.place = np.full(SPACE, -1, np.int32)
            self.place[used] = np.arange(len(used))
            if len(used) * self.n <= DENSE_CELLS:
                self.marks = np.zeros((len(used), self.n), np.float32)
                self.marks[np.repeat(np.arange(len(used)), np.diff(self.starts)[used]), self.which] = self.held
        return self.marks is not None

    def kernels(self, many: list):
        """Texts (their n-grams) x landmarks."""
        import numpy as np

        if self._dense():
            x = np.zeros((len(many), self.marks.shape[0]), np.float32)
            for row, grams in enumerate(many):
                at = self.place[grams]
                own = at >= 0
                x[row, at[own]] = spectrum_weights(grams)[own]
            return x @ self.marks
        out = np.zeros((len(many), self.n), np.float32)
        for row, grams in enumerate(many):
            begin, cells = self.starts[grams].astype(np.int64), (self.starts[grams + 1] - self.starts[grams]).astype(np.int64)
            upto = np.cumsum(cells)
            at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - upto + cells, cells)
            out[row] = np.bincount(self.which[at], self.held[at] * np.repeat(spectrum_weights(grams), cells), self.n)
        return out

    def scores(self, many: list):
        """Texts x languages, about 1 for the language and 0 for others."""
        return self.kernels(many) @ self.weights + self.bias


def landmarks_of(rows: list[tuple[str, object]], langs: list[str]) -> list:
    """The landmarks' n-grams: of each language in turn its next row, while the bounds have room; at least one."""
    each = min(LANDMARKS_PER_LANG, max(1, LANDMARKS // len(langs)))
    by_lang: dict[str, list] = {lang: [] for lang in langs}
    for lang, grams in rows:
        if len(by_lang[lang]) < each:
            by_lang[lang].append(grams)
    chosen, total = [], 0
    for turn in range(each):
        for lang in langs:
            if turn < len(by_lang[lang]) and len(chosen) < LANDMARKS and (not chosen or total + len(by_lang[lang][turn]) <= MARK_GRAMS):
                chosen.append(by_lang[lang][turn])
                total += len(by_lang[lang][turn])
    return chosen


def train(rows: list[tuple[str, object]], ridge: float = 1e-3) -> KernelModel | None:
    """rows: (lang, n-grams)."""
    import numpy as np

    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    chosen = landmarks_of(rows, langs)
    model = KernelModel(langs, chosen)
    values, vectors = np.linalg.eigh(model.kernels(chosen).astype(np.float64))
    good = values > 1e-6 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([model.kernels([g for _, g in rows[i : i + 256]]) @ half for i in range(0, len(rows), 256)])
    number = {lang: k for k, lang in enumerate(langs)}
    lang = np.array([number[l] for l, _ in rows])
    weight = 1.0 / np.bincount(lang, minlength=len(langs))[lang]
    weight /= weight.sum()
    middle, target = weight @ phi, np.full(len(langs), 1 / len(langs))
    centred = (phi - middle) * weight[:, None]
    of_lang = np.zeros((phi.shape[1], len(langs)))
    np.add.at(of_lang.T, lang, centred)  # centred' y of one-hot y; the middle of y drops out
    beta = np.linalg.solve(centred.T @ (phi - middle) + ridge * np.eye(phi.shape[1]) / len(rows) ** 0.5, of_lang)
    model.weights = (half @ beta).astype(np.float32)
    model.bias = (target - middle @ beta).astype(np.float32)
    return model


def fit(docs: DataFrame) -> KernelModel | None:
    """The model of the training rows of docs."""
    import numpy as np

    spark = docs.sparkSession
    ready = small_batches(docs).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "lang is not null and text is not null"
    ).where(~held_out(F.col("doc_id")))
    order = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40))
    counts = ready.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_ROWS).collect()
    if not counts:
        return None
    each = min(PER_LANG, max(1, FIT_ROWS // len(counts)))
    # half as many again as needed, so that chance seldom leaves too few
    below = [(r["lang"], min(1 << 40, int((1 << 40) * (1.5 * each + 50) / r["n"]))) for r in counts]
    limits = F.broadcast(spark.createDataFrame(below, "lang string, below long"))  # at most FIT_ROWS rows

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spectrum = Spectrum()
        for batch in batches:
            for start, texts in texts_in(batch, "text"):
                grams = [spectrum(t) for t in texts]
                own = batch.slice(start, len(texts))
                held = pa.array([None if g is None else g.astype("<i4") for g in grams], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("h"), own.column("t"), held], ["lang", "h", "t", "grams"])

    few = ready.withColumn("h", order).join(limits, "lang").where("h < below").select("lang", "h", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "lang string, h long, t long, grams array<int>")
    # The limit a language holds though one id may be that of many rows; it is taken before the shuffle too.
    ranked = few.where("grams is not null").withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= each)
    ranked = stored(ranked, "lang-sample")
    sizes = ranked.groupBy("k").agg(F.sum(F.size("grams")).alias("n")).orderBy("k").collect()  # at most PER_LANG rows
    total = np.cumsum([r["n"] for r in sizes])
    last = max(1, int((total <= SAMPLE_GRAMS).sum()))
    sample = ranked.where(F.col("k") <= last).toArrow()
    grams = sample.column("grams").combine_chunks()
    order_of = sorted(zip(*(sample.column(c).to_pylist() for c in ("h", "lang", "t")), range(sample.num_rows)))
    taken = [(lang, np.asarray(grams[i].values)) for _, lang, _, i in order_of]
    return train(taken)


def _shared(docs: DataFrame, model: KernelModel | None):
    """The model as a broadcast. Its landmarks' cells are bounded by MARK_GRAMS, its weights by LANDMARKS x languages."""
    if model is not None and model.size() > 8 * MARK_GRAMS + 8 * SPACE + 4 * (LANDMARKS + 1) * len(model.langs):
        raise ValueError("the language model is larger than its bounds allow")
    return docs.sparkSession.sparkContext.broadcast(model)


def _best(model: KernelModel | None, spectrum: Spectrum, texts: list) -> Iterator[tuple[int, str, float]]:
    """(place, language, score) of those texts that have a letter."""
    grams = [spectrum(t) for t in texts]
    known = [i for i, g in enumerate(grams) if g is not None] if model else []
    if known:
        found = model.scores([grams[i] for i in known])
        for i, best, value in zip(known, found.argmax(axis=1), found.max(axis=1)):
            yield i, model.langs[best], float(value)


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = _shared(docs, model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        spectrum, own = Spectrum(), shared.value
        for batch in batches:
            langs, scores = ["und"] * len(batch), np.zeros(len(batch))
            for start, texts in texts_in(batch, "text", 128):
                for i, lang, value in _best(own, spectrum, texts):
                    langs[start + i], scores[start + i] = lang, min(1.0, max(0.0, value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = LEAST_EXCESS) -> DataFrame:
    """docs, with their columns, whose language is known: the best of K scores lies ``least`` of the way from 1/K to 1 or more (of one learned language, whatever has a letter)."""
    model = fit(docs)
    shared, even = _shared(docs, model), 1 / len(model.langs) if model else 1.0

    @F.pandas_udf("double")
    def excess(texts: pd.Series) -> pd.Series:
        import numpy as np

        spectrum, own, out = Spectrum(), shared.value, np.full(len(texts), -1.0)
        for start in range(0, len(texts), 128):
            for i, _, value in _best(own, spectrum, texts.iloc[start : start + 128]):
                out[start + i] = (value - even) / (1 - even) if even < 1 else 1.0
        return pd.Series(out)

    return small_batches(docs).where(excess(F.col("text").cast("string")) >= least)
