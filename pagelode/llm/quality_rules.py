"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document. A ledger row holds the
measurements and ``failed``, whose bit i says that rule i failed. Policies
(versioned bitmasks) and ablations then need the ledger alone, not the texts.

Defined cases: a null text counts as an empty one; an empty text has no words
and fails ``few_words``; repeated rows give repeated ledger rows; an empty table
gives an empty ledger; further columns are ignored by ``ledger`` and kept by
``keep_documents``. Equality of 5-word windows is decided by a 64-bit hash
chain over the five words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Bit i of a ledger's mask belongs to the i-th rule. Conditions under which a rule fails, over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "digits": "2 * n_digits > word_chars",
    "cut_lines": "10 * n_cut_lines > 3 * n_lines",
    "stutter": "10 * n_stutters > 3 * n_words",
}
#: Rules of each policy version; the first two are part of every policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_cut_lines", "n_stutters")


def policy_mask(version: str) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[version])


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a struct column ``_m`` of the measurements; other columns stay.

    A row number in the struct keeps the optimizer from moving filters below the
    measurements, which would write each of them out anew wherever it is used.
    """
    with_words = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words_of(F.col("_t")))
    counted = with_words.withColumn("_n", F.size("_w")).withColumn(
        "_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    )

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])

    hashed = counted.withColumn(
        "_h",
        F.when(F.col("_n") > WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")),
    )
    # Only texts with a repeated window sort their windows.
    placed = hashed.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_h")

    def repeated(x: Column, k: Column) -> Column:
        same = lambda j: F.coalesce(F.get("_s", j)["h"] == x["h"], F.lit(False))
        return same(k + 1) | F.when(k > 0, same(k - 1)).otherwise(F.lit(False))

    found = placed.withColumn("_p", F.sort_array(F.transform(F.filter("_s", repeated), lambda x: x["i"]))).drop("_s")
    after = F.slice("_p", F.lit(2), F.size("_p") - 1)
    covered = F.aggregate(F.zip_with(after, F.slice("_p", F.lit(1), F.size("_p") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x) + WINDOW
    without = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    return found.withColumn(
        "_m",
        F.struct(
            F.monotonically_increasing_id().alias("row"),
            F.col("_n").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            without(SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("_p").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            without("0123456789").cast("long").alias("n_digits"),
            F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_cut_lines"),
            F.size(F.filter("_w", lambda x, i: F.coalesce(F.get("_w", i + 1) == x, F.lit(False)))).cast("long").alias("n_stutters"),
        ),
    ).drop("_t", "_w", "_n", "_lines", "_p")


def _failed(prefix: str = "") -> Column:
    mask = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        named = rule
        for m in sorted(MEASURES, key=len, reverse=True):
            named = _qualified(named, m, prefix)
        mask = mask.bitwiseOR(F.when(F.expr(named), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return mask


def _qualified(rule: str, measure: str, prefix: str) -> str:
    import re

    return re.sub(rf"(?<![\w.]){measure}\b", prefix + measure, rule)


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, all measurements, and ``failed``: the mask of failed rules."""
    rows = measured(df.select(F.col(key), F.col(text).alias("_text")), "_text")
    return rows.select(key, *[F.col("_m")[m].alias(m) for m in MEASURES]).withColumn("failed", _failed())


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    bad = lambda v: F.col("failed").bitwiseAND(F.lit(policy_mask(v))) != 0
    return rows.withColumn("base_failed", bad("base")).withColumn("kept", ~bad("base") & ~bad(version))


def ablation(rows: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: documents it fails, and those that no other rule of the policy fails.

    The ledger shrinks to one count for each mask (at most two to the number of rules) before rules are looked at.
    """
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy_mask(version))).alias("mask")).agg(F.count("*").alias("n"))
    bits = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(RULES) if name in POLICIES[version]])
    each = masks.select("mask", "n", F.inline(bits))
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )


def keep_documents(docs: DataFrame, version: str = "v2", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that pass a policy."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text).alias("_text"))
    passed = _failed("_m.").bitwiseAND(F.lit(policy_mask(version) | policy_mask("base"))) == 0
    return measured(whole, "_text").where(passed).select("_doc.*")
