"""Edit-aware token counts: segment trees over pre-tokens, kept for each document.

A text is cut into leaves of about ``LEAF`` words, before white space where there
is some; a run of more than ``LONG_RUN`` characters without any is cut between
pre-tokens that the tokenizer would encode apart in any case, if normalising
changes nothing but its case (else it stays whole). The text's count is
the sum of its leaves' counts. A segment tree holds, for each subtree, the sum of
characters and of tokens. ``trees`` makes a table of them, which is small and is
kept; ``apply_edits`` takes a table of edits, reads the texts and trees of the
edited documents alone, and returns their counts, new texts and new trees. An
edit descends by characters to the leaves that it touches, takes in the leaves
before and after where the cut between them and the new text would not be sound,
re-encodes that region alone, and updates the sums on the way up.

Defined cases: a null text is empty and has no tokens; edits beyond the end are
cut to the text; documents without an edit are not in the result; rows that share
id and text share a tree and are edited each; a null doc_id matches the edits of
the null id; a stored tree that does not fit its text is an error; empty tables
give empty results; further columns are ignored. The edits of one document apply
one after another, so they are one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import default_tokenizer, encoder, small_batches, stored, texts_in

LEAF = 64
LONG_RUN = 512


#: Strings that the tokenizer takes whole before anything else.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


@cache
def _patterns():
    """Runs up to white space (the encoder's plain separators), and pre-tokens of texts that are not lower-cased yet."""
    import re

    import regex

    special = "|".join(map(re.escape, SPECIAL))
    marks = "|".join("'" + "".join(f"[{c}{c.upper()}]" for c in tail) for tail in ("s", "t", "re", "ve", "m", "ll", "d"))
    return re.compile(r"[ \n]*[^ \n]*"), regex.compile(f"{special}|{marks}|\\p{{L}}+|\\p{{N}}|(?:(?!{special})[^\\s\\p{{L}}\\p{{N}}])+")


def _plain(text: str) -> bool:
    """Whether normalising changes nothing but case, so that pre-tokens can be told from the text itself."""
    import unicodedata

    return text.isprintable() and (text.isascii() or ("\u0130" not in text and unicodedata.is_normalized("NFC", text)))


def _apart(x: str, y: str) -> bool:
    """Whether no special token or combining mark reaches across the cut between two characters."""
    import unicodedata

    return x not in "<|>" and y not in "<|>" and (y < "\x80" or not unicodedata.category(y).startswith("M"))


def sound_cut(left: str, right: str) -> bool:
    """Whether left, which starts at a sound cut, and right are encoded apart."""
    if not left or not right or right[0] in " \n":
        return True
    if not _apart(left[-1], right[0]):
        return False
    start = max(left.rfind(" "), left.rfind("\n")) + 1
    near = left[start:] + right[:4].split(" ")[0].split("\n")[0]
    return _plain(near) and not any(m.start() < len(left) - start < m.end() for m in _patterns()[1].finditer(near))


def _leaves(text: str, leaf: int) -> Iterator[str]:
    """Runs of about ``leaf`` words, or of as many pre-tokens where no white space parts them."""
    runs, parts = _patterns()
    start = words = 0
    for run in runs.finditer(text):
        if run.end() - run.start() > LONG_RUN and _plain(run.group().lstrip(" \n")):
            for n, part in enumerate(parts.finditer(text, run.start(), run.end()), 1):
                if n % leaf == 0 and part.end() < run.end() and _apart(text[part.end() - 1], text[part.end()]):
                    yield text[start : part.end()]
                    start, words = part.end(), 0
        words += 1
        if words == leaf:
            yield text[start : run.end()]
            start, words = run.end(), 0
    if start < len(text):
        yield text[start:]


class TokenTree:
    """Token count of one text under edits. ``reencoded`` counts characters given to the encoder by edits."""

    def __init__(self, text: str, count, leaf: int = LEAF):
        leaves = list(_leaves(text, leaf)) or [""]
        self._fill(leaves, list(map(len, leaves)), list(map(count, leaves)), count)

    def _fill(self, leaves: list[str], chars: list[int], tokens: list[int], count) -> None:
        self.count, self.reencoded, self.leaves = count, 0, leaves
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.chars, self.tokens = ([0] * self.size + x + [0] * (self.size - len(x)) for x in (chars, tokens))
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    @classmethod
    def kept(cls, text: str, chars: list[int], tokens: list[int], count) -> TokenTree:
        """The tree of a text from its leaves' sizes and counts; nothing is encoded."""
        tree, leaves, at = cls.__new__(cls), [], 0
        for n in chars:
            leaves.append(text[at : at + n])
            at += n
        if at != len(text):
            raise ValueError("a stored tree does not fit its text")
        tree._fill(leaves or [""], chars or [0], tokens or [0], count)
        return tree

    def stored(self) -> tuple[list[int], list[int]]:
        """Sizes and counts of the leaves that have text."""
        used = [k for k, x in enumerate(self.leaves) if x]
        return [self.chars[self.size + k] for k in used], [self.tokens[self.size + k] for k in used]

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and its place there; at the end, the end of the last leaf with text."""
        at = min(at, self.chars[1])
        node = 1
        while node < self.size:
            left = self.chars[2 * node]
            if at < left or (at == left and not self.chars[2 * node + 1]):
                node *= 2
            else:
                at, node = at - left, 2 * node + 1
        return node - self.size, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.size + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self._sum(node)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end by new."""
        total = self.chars[1]
        start = max(0, min(start, total))
        end = max(start, min(end, total))
        first, a = self._leaf_at(start)
        last, b = self._leaf_at(end)
        region = self.leaves[first][:a] + new + self.leaves[last][b:]
        before, after = first, last
        while before and not sound_cut(self.leaves[before - 1], region):  # boundary context: what it would join
            before -= 1
            region = self.leaves[before] + region
        while after + 1 < len(self.leaves) and not (self.leaves[after + 1] and sound_cut(region, self.leaves[after + 1])):
            after += 1
            region += self.leaves[after]
        for leaf in range(before, after + 1):
            if leaf != before and self.leaves[leaf]:
                self._set(leaf, "", 0)
        self.reencoded += len(region)
        self._set(before, region, self.count(region))


def _counter(path: str):
    own = encoder(path)
    return lambda text: len(own.ids(text)) // 4


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text_hash, n_tokens, chars, tokens (of the leaves): one row for each row of docs; to be stored."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = _counter(path)
        for batch in batches:
            totals, chars, tokens = [], [], []
            for _, texts in texts_in(batch, "text"):
                for text in texts:
                    tree = TokenTree(text, count)
                    totals.append(tree.total)
                    for column, value in zip((chars, tokens), tree.stored()):
                        column.append(value)
            ints = pa.list_(pa.int32())
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(totals, pa.int64()), pa.array(chars, ints), pa.array(tokens, ints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_tokens", "chars", "tokens"])

    return small_batches(_keyed(docs)).mapInArrow(run, "doc_id long, text_hash long, n_tokens long, chars array<int>, tokens array<int>")


def apply_edits(docs: DataFrame, kept: DataFrame, edits: DataFrame, tokenizer: str | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, text_hash, n_tokens, n_edits, edited_n_tokens, reencoded_chars, chars, tokens (of the new tree), and the new text if asked for.

    edits: doc_id, seq, start, stop, new, and text_hash where they mean one text of an id.
    """
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, text_hash long, n_tokens long, n_edits long, edited_n_tokens long, reencoded_chars long, chars array<int>, tokens array<int>" + ", text string" * with_text

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        count = _counter(path)
        kinds = [*[pa.int64()] * 6, *[pa.list_(pa.int32())] * 2, pa.string()]
        for batch in batches:
            for start, texts in texts_in(batch, "text"):
                own, out = batch.slice(start, len(texts)), []
                for text, key, text_hash, chars, tokens, todo in zip(texts, *(own.column(c).to_pylist() for c in ("doc_id", "text_hash", "chars", "tokens", "todo"))):
                    tree = TokenTree.kept(text, chars, tokens, count)
                    before = tree.total
                    for change in todo:
                        tree.edit(change["start"], change["stop"], change["new"] or "")
                    after = tree.text
                    new_hash = xxh64_intdigest(after.encode(), 42)  # what Spark's xxhash64 gives
                    out.append((key, new_hash - (1 << 64) if new_hash >> 63 else new_hash, before, len(todo), tree.total, tree.reencoded, *tree.stored(), after)[: len(kinds) - (not with_text)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

    each = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "new")
    keys = [F.col("doc_id").cast("long").alias("_id"), *[F.col("text_hash").alias("_hash")] * ("text_hash" in edits.columns)]
    todo = edits.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("todo"))
    one = kept.groupBy("doc_id", "text_hash").agg(F.first(F.struct("chars", "tokens")).alias("tree"))
    same = one["doc_id"].eqNullSafe(todo["_id"])
    plan = one.join(todo, same & (one["text_hash"] == todo["_hash"]) if "_hash" in todo.columns else same)  # edits meet trees first: both are small beside the texts
    plan = plan.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "tree", "todo")
    rows = _keyed(docs)
    found = rows.join(plan, rows["doc_id"].eqNullSafe(plan["_doc_id"]) & (rows["text_hash"] == plan["_text_hash"]))
    return small_batches(found.select("doc_id", "text_hash", "text", "todo", "tree.*")).mapInArrow(run, schema)


def sample_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, seq, start, stop, new: three edits of each document, an insertion inside, a deletion and a replacement, at places spread by the id."""
    rows = _keyed(docs).select("doc_id", "text_hash", F.length("text").cast("long").alias("n")).distinct()
    seed = F.pmod(F.coalesce("doc_id", F.lit(0)) * 2654435761, F.lit(1 << 32))
    at = lambda k: F.pmod(F.shiftright(seed, 4 * k), F.col("n") + 1)
    edit = lambda k, length, new: F.struct(F.lit(k).alias("seq"), at(k).alias("start"), (at(k) + length).alias("stop"), F.lit(new).alias("new"))
    return rows.select("doc_id", "text_hash", F.inline(F.array(edit(0, 0, "an inserted phrase, "), edit(1, 24, ""), edit(2, 9, " changed"))))


def counts(docs: DataFrame, tokenizer: str | None = None, edits: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, edited_n_tokens, reencoded_chars of whole texts: trees are made and stored, then the edits (by default ``sample_edits``) applied to them."""
    kept = stored(trees(docs, tokenizer), "token-trees")
    changed = apply_edits(docs, kept, sample_edits(docs) if edits is None else edits, tokenizer)
    return changed.select("doc_id", "n_tokens", "n_edits", "edited_n_tokens", "reencoded_chars")
