"""A weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Expectation-maximisation over the table of vote patterns (at most 3 to the
number of labellers rows, whatever the corpus) estimates each labeller's
accuracy and each pattern's posterior. The posteriors label at most ``FIT_ROWS``
documents, taken by a hash of doc_id below a threshold, on which a linear
scorer over hashed words and word ends is fitted; it then scores every whole
text.

Defined cases: a null text is an empty one: labelled by its length alone and
scored by the bias; repeated rows are scored alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import ASCII_UPPER, small_batches, texts_in

FIT_ROWS = 4000
WIDTH = 1 << 13
ENDS, SHARES = 256, 33  # places for word ends and for shares of the text
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "der", "die", "und", "das", "den", "le", "la", "de", "et", "les", "que", "el", "los", "y", "en", "un")

_SYMBOLS, _UPPER, _STOPS = b"#*$%&|<>", ASCII_UPPER.encode(), frozenset(w.encode() for w in STOP_WORDS)


class Measures:
    """What labellers and features look at, over the UTF-8 of a whole text."""

    def __init__(self, text: str | None):
        from collections import Counter
        from operator import eq

        raw = (text or "").encode()
        self.words = raw.split()
        self.seen = Counter(self.words)
        self.n, self.distinct, self.size = len(self.words), len(self.seen), len(raw)
        self.chars = sum(map(len, self.words))
        self.symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        self.upper = len(raw) - len(raw.translate(None, _UPPER))
        self.stopped = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
        self.stutters = sum(map(eq, self.words, self.words[1:]))
        self.stops = len(_STOPS.intersection(self.seen)) if self.distinct else 0
        self.last = self.words[-1][-1:] if self.words else b""


def _vote(bad: bool, good: bool) -> int:
    return 1 if bad else 2 if good else 0


#: What each labeller votes: 2 good, 1 bad, 0 abstains.
LABELLERS: dict[str, Callable[[Measures], int]] = {
    "length": lambda m: _vote(m.n < 10, m.n >= 40),
    "symbols": lambda m: _vote(m.n > 0 and m.symbols > 0.1 * m.n, m.n > 0 and m.symbols < 0.01 * m.n),
    "stop_words": lambda m: 0 if m.n < 20 else _vote(m.stops == 0, m.stops >= 3),
    "variety": lambda m: 0 if m.n < 50 else _vote(m.distinct < 0.12 * m.n, m.distinct > 0.3 * m.n),
    "word_length": lambda m: 0 if m.n < 5 else _vote(m.chars < 2.5 * m.n or m.chars > 14 * m.n, 3 * m.n <= m.chars <= 9 * m.n),
    "stutter": lambda m: 0 if m.n < 5 else _vote(m.stutters > 0.15 * m.n, m.stutters < 0.03 * m.n),
    "shouting": lambda m: 0 if m.chars < 20 else _vote(m.upper > 0.3 * m.chars, m.upper < 0.15 * m.chars),
    "ending": lambda m: _vote(bool(m.last) and m.last in _SYMBOLS, m.last in (b".", b"!", b"?")),
    "sentences": lambda m: 0 if m.n < 20 else _vote(m.n > 120 * m.stopped, 2 * m.stopped <= m.n <= 50 * m.stopped),
}
PATTERNS = 3 ** len(LABELLERS)


def votes(measures: Measures) -> int:
    """The labellers' votes as digits to the base 3."""
    code = 0
    for labeller in LABELLERS.values():
        code = 3 * code + labeller(measures)
    return code


def patterns_of(docs: DataFrame) -> dict[int, int]:
    """How many documents have each vote pattern: at most PATTERNS rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(Measures(t)) for _, texts in texts_in(batch, "text") for t in texts], pa.int32())], ["votes"])

    cast = small_batches(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "votes int")
    return {r["votes"]: r["n"] for r in cast.groupBy("votes").agg(F.count("*").alias("n")).collect()}


def digits(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, digit = divmod(code, 3)
        out.append(digit)
    return out[::-1]


def estimate(patterns: dict[int, int], rounds: int = 200):
    """(posterior that a document is good, by pattern; each labeller's chance to vote right, good then bad) by expectation-maximisation."""
    import numpy as np

    codes = sorted(patterns)
    if not codes:
        return {}, []
    n = np.array([patterns[c] for c in codes], float)
    cast = np.array([digits(c) for c in codes])
    good, bad = (cast == 2).astype(float), (cast == 1).astype(float)
    post = np.clip((good.sum(1) - 1.5 * bad.sum(1)) / np.maximum(1, (cast > 0).sum(1)) * 0.5 + 0.5, 0.02, 0.98)
    for _ in range(rounds):
        share = np.clip((n @ post) / n.sum(), 0.02, 0.98)
        hit = lambda w, v: (2 + (w * n) @ v) / (4 + (w * n) @ (good + bad))  # noqa: E731  two of each vote beforehand
        right, wrong = hit(post, good), hit(1 - post, good)
        odds = np.log(share / (1 - share)) + good @ np.log(right / wrong) + bad @ np.log((1 - right) / (1 - wrong))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(codes, post.tolist())), list(zip(right.tolist(), (1 - wrong).tolist()))


def features(m: Measures):
    """(places, values) of the hashed features of a whole text, with unit length."""
    from collections import Counter
    from zlib import crc32

    import numpy as np

    if not m.n:
        return np.empty(0, np.int64), np.empty(0)
    ends = Counter(w[-1:] for w in m.words)
    start = WIDTH - ENDS - SHARES
    shares = (m.stutters / m.n, m.upper / m.size, m.distinct / m.n)
    places = [crc32(w) % start for w in m.seen] + [start + 11 * k + round(10 * x) for k, x in enumerate(shares)] + [WIDTH - ENDS + e[0] for e in ends]
    words = np.log1p(np.fromiter(m.seen.values(), float, m.distinct))
    lasts = 3 * np.log1p(np.fromiter(ends.values(), float, len(ends)))
    values = np.concatenate([words, [0.5 * np.sqrt(words @ words + lasts @ lasts)] * len(shares), lasts])
    return np.array(places, np.int64), values / np.sqrt(values @ values)


def fit_scorer(rows: list, labels, rounds: int = 150, decay: float = 1e-5):
    """Weights (the last is the bias) of a logistic scorer of soft labels, by full-batch Adam."""
    import numpy as np

    w = np.zeros(WIDTH + 1)
    if not rows:
        return w
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row, y = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.asarray(labels, float)
    weight = np.where(y > 0.5, 0.5 / max(1.0, (y > 0.5).sum()), 0.5 / max(1.0, (y <= 0.5).sum()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[at], len(rows)) + w[-1])))
        error = weight * (p - y)
        slope = np.append(np.bincount(at, value * error[row], WIDTH), error.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    return w


def classify(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """doc_id, votes, posterior, score (the scorer's, 0 to 1), kept."""
    import numpy as np

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    patterns = patterns_of(rows)
    by_code = np.full(PATTERNS, 0.5)
    for code, value in estimate(patterns)[0].items():
        by_code[code] = value
    weights = _fitted(rows, sum(patterns.values()), by_code)
    shared = docs.sparkSession.sparkContext.broadcast((by_code, weights))  # PATTERNS and WIDTH + 1 numbers

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        by_code, w = shared.value
        for batch in batches:
            codes, scores = [], []
            for _, texts in texts_in(batch, "text"):
                for text in texts:
                    m = Measures(text)
                    at, value = features(m)
                    codes.append(votes(m))
                    scores.append(float(w[at] @ value + w[-1]))
            score = 1 / (1 + np.exp(-np.array(scores, float)))
            cast = np.array(codes, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cast), pa.array(by_code[cast]), pa.array(score)], ["doc_id", "votes", "posterior", "score"])

    return rows.mapInArrow(run, "doc_id long, votes int, posterior double, score double").withColumn("kept", F.col("score") >= keep_from)


def _fitted(rows: DataFrame, n: int, by_code):
    """The scorer's weights from at most FIT_ROWS rows, labelled by their posteriors."""
    import numpy as np

    order = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1 << 40))
    below = min(1 << 40, int((1 << 40) * (1.1 * FIT_ROWS + 100) / max(n, 1)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            seen = [Measures(t) for _, texts in texts_in(batch, "text") for t in texts]
            found = [features(m) for m in seen]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("t"), pa.array([votes(m) for m in seen], pa.int32()), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
                ["h", "t", "votes", "at", "value"],
            )

    found = rows.withColumn("h", order).where(F.col("h") < below).select("h", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "h long, t long, votes int, at array<long>, value array<double>")
    sample = found.orderBy("h", "t").limit(FIT_ROWS).toArrow()  # the limit holds though one id may be that of many rows
    if not sample.num_rows:
        return fit_scorer([], [])
    at, value, cast = (sample.column(c).combine_chunks() for c in ("at", "value", "votes"))
    return fit_scorer([(np.asarray(at[i].values), np.asarray(value[i].values)) for i in range(len(cast))], [by_code[c] for c in cast.to_pylist()])


def accuracies(docs: DataFrame) -> dict[str, tuple[float, float]]:
    """Each labeller's estimated chance to be right on good and on bad documents, where it votes."""
    return dict(zip(LABELLERS, estimate(patterns_of(docs))[1]))
