"""Rule bitmask ledger: every quality rule is evaluated once, policies are applied to bits afterwards.

``ledger`` keeps for each document its measurements and one 64-bit word of failed rules.  A policy is a
named, versioned set of rules, that is a mask; applying it, comparing versions and ablating a rule need
only bit operations over the ledger, never the texts again.

Edge cases: a null or empty text has no words, no lines and fails ``min_words``; repeated documents each
get a row; an empty table gives an empty ledger; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_batch, column, positional

#: Rule -> bit.  Bits are never reused, so that ledgers of all versions stay readable.
RULES = {"min_words": 0, "repeat_words": 1, "word_length": 2, "symbols": 3, "dup_lines": 4, "long_word": 5}

#: (policy, version) -> rules.
POLICIES: Mapping[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("min_words", "repeat_words"),
    ("web", 1): ("min_words", "repeat_words", "symbols"),
    ("web", 2): ("min_words", "repeat_words", "word_length", "symbols", "dup_lines", "long_word"),
    # By its ablation, dup_lines alone rejects only documents that are labelled good.
    ("web", 3): ("min_words", "repeat_words", "word_length", "symbols", "long_word"),
}

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, longest_word long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((x.split()[0], pa.int64()) for x in MEASURES.split(", "))])


def repeated(words: list[bytes], size: int = 3) -> int:
    """How many words lie in windows of ``size`` words found at least twice in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    key = ids[:n]
    for k in range(1, size):
        key = key * len(known) + ids[k : k + n] if len(known) < 2_000_000 else np.unique(np.stack((key, ids[k : k + n])), axis=1, return_inverse=True)[1].reshape(-1)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(words) + 1, dtype=np.int32)
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + size, -1)
    return int(np.count_nonzero(np.cumsum(twice)[:-1]))


def measure(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()
    blank = len(data) - len(data.translate(None, SPACE))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), len(text or "") - blank, len(data) - len(data.translate(None, b"#*$%&|<>")), len(lines), len(lines) - len(set(lines)), repeated(words), max(map(len, words), default=0))


def _measured(rows: dict[str, list]) -> dict[str, list]:
    got = [measure(x) for x in rows["text"]]
    return {"doc_id": rows["doc_id"]} | {k: [x[i] for x in got] for i, k in enumerate(_SCHEMA.names[1:])}


def fail_bits() -> Column:
    """One word of failed rules from the measurements, in integer arithmetic."""
    c = F.col
    rules = {
        "min_words": c("n_words") < 50,
        "repeat_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "long_word": c("longest_word") > 1000,
    }
    bits = F.lit(0).cast("long")
    for name, failed in rules.items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << RULES[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its measurements and ``fail_bits``."""
    read = positional(docs).select(F.col(column(docs, doc_id)).cast("long").alias("doc_id"), F.col(column(docs, text)).cast("string").alias("text"))
    return read.mapInArrow(by_batch(_measured, _SCHEMA), f"doc_id long, {MEASURES}").withColumn("fail_bits", fail_bits())


def mask(policy: str, version: int) -> int:
    return sum(1 << RULES[x] for x in POLICIES[policy, version])


def passes(policy: str, version: int, bits: str = "fail_bits") -> Column:
    """Whether a ledger's row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy, version)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str, version: int) -> DataFrame:
    """For each rule of a policy: what fails it, and what only this rule rejects; one pass over the bits.

    ``kept_without`` is how many documents the policy would keep without the rule.
    """
    m = mask(policy, version)
    own = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    names = POLICIES[policy, version]
    one = rows.agg(F.count("*").alias("n"), F.count_if(own == 0).alias("kept"), *(F.count_if(own.bitwiseAND(F.lit(1 << RULES[x]).cast("long")) != 0).alias(f"f_{x}") for x in names), *(F.count_if(own == (1 << RULES[x])).alias(f"o_{x}") for x in names))
    return one.select("n", "kept", F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.col(f"f_{x}").alias("failed"), F.col(f"o_{x}").alias("failed_alone")) for x in names))).alias("r")).select("n", "kept", "r.*").withColumn("kept_without", F.col("kept") + F.col("failed_alone"))
