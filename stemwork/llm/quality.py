"""Quality rules as a ledger of bits: every rule is evaluated once a document, policies decide on the bits.

One pass over the texts measures each document and sets a bit for each rule that it fails. The ledger (bits
and measurements, no texts) is a table to keep. A policy is a versioned mask over those bits with a number of failures
that it tolerates, so a new policy, or the same without a rule, reads the ledger and no text. Ablations count documents by the pattern of their
masked bits, of which there are few, and get all figures of all rules from those counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import parts

_WORD, _BLANK = re.compile(r"[^\x20\x09-\x0D]+"), " \t\n\x0b\x0c\r"
SYMBOLS, BULLETS, ELLIPSES, ENDS = "#*$%&|<>", ("-", "*", "•"), ("...", "…"), (".", "!", "?", '"', "'", "”", "»")

#: What is measured of a text, in this order. Lines are those with a word.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "longest_word", "n_bullets", "n_ellipses", "n_ended_lines")

#: Rules in the order of their bits: a document fails where the test over its measurements holds. Ratios are compared in
#: whole numbers, so that any engine decides alike. New rules go to the end; a bit never changes its meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "many_words": "n_words > 100000",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "few_letters": "5 * n_letter_words < 4 * n_words",
    "giant_word": "longest_word > 1000",
    "bullets": "10 * n_bullets > 9 * n_lines",
    "ellipses": "10 * n_ellipses > 3 * n_lines",
    "open_lines": "10 * n_ended_lines < n_lines",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """The rules that a version rejects by, and how many of the lenient ones a document may fail; failing any other rejects."""

    version: str
    rules: tuple[str, ...]
    lenient: tuple[str, ...] = ()
    tolerated: int = 0

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)

    def without(self, rule: str) -> Policy:
        return Policy(f"{self.version}-{rule}", tuple(r for r in self.rules if r != rule), self.lenient, self.tolerated)

    def rejects(self, failed: Column) -> Column:
        lenient = sum(BITS[r] for r in self.lenient if r in self.rules)
        hard = failed.bitwiseAND(self.mask & ~lenient) != 0
        return hard | (F.bit_count(failed.bitwiseAND(lenient)) > self.tolerated) if lenient else hard


BASE = Policy("base", ("few_words", "repeated_words"))
#: Every rule rejects, but text made of lines without an end, of bullets or of ellipses must fail two of these.
STRICT = Policy("2", tuple(RULES), ("bullets", "ellipses", "open_lines"), 1)
#: Rules on words and repetition only.
PLAIN = Policy("1", tuple(r for r in RULES if r not in STRICT.lenient))


def measured(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text; a null one has no words and no lines."""
    text = text or ""
    words = _WORD.findall(text)
    n, ids = len(words), {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    times = np.bincount(x, minlength=len(ids))
    lettered = np.array([any(map(str.isalpha, w)) for w in ids], bool)
    repeated = np.zeros(n, bool)
    if n > 3:
        pair = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)[1]
        _, window, often = np.unique(pair[:-1] * len(ids) + x[2:], return_inverse=True, return_counts=True)
        twice = often[window] > 1
        for k in range(3):
            repeated[k : n - 2 + k] |= twice
    lines = [y for y in text.split("\n") if y.strip(_BLANK)]
    bare = [y.strip(_BLANK) for y in lines]
    return (
        n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), int(repeated.sum()), int(times @ lettered), max(map(len, ids), default=0),
        sum(y.startswith(BULLETS) for y in bare), sum(y.endswith(ELLIPSES) for y in bare), sum(y.endswith(ENDS) for y in bare),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 256):
        found = list(zip(*map(measured, batch.column("text").to_pylist()))) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in found)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the rules that each row of docs fails.

    Null texts count as empty; those without words fail few_words and no ratio. Rows with equal or null doc_ids have
    rows of their own; extra columns are left out.
    """
    kinds = ", ".join(f"{m} long" for m in MEASURES)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, f"doc_id long, {kinds}")
    bits = [F.when(F.expr(test), F.lit(BITS[name])).otherwise(0).cast("long") for name, test in RULES.items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def decided(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger's rows with `kept` under a policy."""
    return rows.withColumn("kept", ~policy.rejects(F.col("failed")))


def ablations(rows: DataFrame, policy: Policy, by: list[str] | None = None) -> DataFrame:
    """For each rule of the policy, and by the columns `by` of the ledger if any: how many of its documents fail it, are kept, and would be kept without it.

    Columns: by, rule, n, failed, rejected, alone (those that only this rule rejects) and kept_without. Counts are
    of documents; the groups' masks in every_bit and any_bit say which rules all of them and any of them fail.
    """
    by = by or []
    masked = F.col("failed").bitwiseAND(policy.mask)
    patterns = rows.groupBy(*by, masked.alias("bits")).agg(F.count("*").alias("n"))
    each = [
        F.struct(F.lit(r).alias("rule"), (F.col("bits").bitwiseAND(BITS[r]) != 0).alias("hit"), policy.rejects(F.col("bits")).alias("out"), policy.without(r).rejects(F.col("bits")).alias("still"))
        for r in policy.rules
    ]
    flat = patterns.withColumn("x", F.explode(F.array(*each)))
    n_if = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return flat.groupBy(*by, F.col("x.rule").alias("rule")).agg(
        F.sum("n").alias("n"), n_if(F.col("x.hit")).alias("failed"), n_if(F.col("x.out")).alias("rejected"), n_if(F.col("x.out") & ~F.col("x.still")).alias("alone"), n_if(~F.col("x.still")).alias("kept_without"),
        F.bit_and("bits").alias("every_bit"), F.bit_or("bits").alias("any_bit"),
    )
