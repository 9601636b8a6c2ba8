"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule; policies
(named, versioned sets of rules) and ablations are then bit operations on the ledger and never read text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, read_table, ship, slices, small_batches

_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_bytes", "n_upper", "n_distinct", "n_bar_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; the rule's place in the tuple is its bit."""

    name: str
    fails: str


#: Order is fixed: a rule's bit never changes, new rules are appended.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule("few_letters", "10 * n_letter_bytes < 6 * word_chars"),
    Rule("mostly_capitals", "2 * n_upper > word_chars"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("bars_between_words", "10 * n_bar_words > n_words"),
)

#: Versioned policies: which rules a document must pass.
POLICIES: dict[str, tuple[str, ...]] = {
    "base/1": ("too_few_words", "repeated_windows"),
    "web/1": tuple(r.name for r in RULES),
}


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << k for k, r in enumerate(rules)}
    return sum(bits[n] for n in names)


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``; a null text measures as an empty one."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    no_space = text.translate(None, SPACES)
    continuation = len(no_space) - len(no_space.translate(None, bytes(range(128, 192))))
    chars = len(no_space) - continuation
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    letters = len(no_space) - len(no_space.translate(None, _LETTERS)) - continuation
    upper = len(no_space) - len(no_space.translate(None, _UPPER))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    codes: dict[bytes, int] = {}
    give = codes.setdefault
    seq = np.fromiter((give(w, len(codes)) for w in words), np.int64, n)
    bars = sum(int(np.count_nonzero(seq == codes[b])) for b in (b"|", b"/", b">") if b in codes)
    return (n, chars, symbols, len(lines) - len(set(lines)), repeat_words(seq, len(codes)), len(lines), letters, upper, len(codes), bars)


def repeat_words(seq: np.ndarray, vocabulary: int) -> int:
    """Number of places in ``seq`` that lie in a window of three that occurs at least twice."""
    if len(seq) < 4:
        return 0
    pair = seq[:-1] * vocabulary + seq[1:]
    if vocabulary >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair[:-1] * vocabulary + seq[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(seq), bool)
    for k in range(3):
        covered[k : len(windows) + k] |= twice
    return int(covered.sum())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measure(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        cols = np.array(rows, np.int64).reshape(len(rows), len(MEASURES)).T
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in cols)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``doc_id``, the measurements, and ``failed`` (long, bit k set where rule k fails).

    A null or empty text measures 0 everywhere and fails ``too_few_words`` alone. A null id stays null; repeated rows stay
    repeated; an empty table gives an empty ledger; other columns are not read.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules fit one ledger")
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    measured = slim.mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", bits)


def passes(failed: Column, policy: str, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger's bits pass a policy."""
    return failed.bitwiseAND(F.lit(mask_of(policies[policy], rules)).cast("long")) == 0


def ablation(led: DataFrame, policy: str, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (and would come back without it), and their words.

    Rows of the ledger are first counted by bit pattern, so what is shuffled has as many rows as there are patterns.
    """
    mask = mask_of(policies[policy], rules)
    patterns = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    chosen = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if (1 << k) & mask))
    each = patterns.select("bits", "docs", "words", F.explode(chosen).alias("r")).select("bits", "docs", "words", "r.rule", "r.bit")
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    zero = F.lit(0).cast("long")
    return each.groupBy("rule").agg(F.sum(F.when(hit, F.col("docs")).otherwise(zero)).alias("failed_docs"), F.sum(F.when(alone, F.col("docs")).otherwise(zero)).alias("only_docs"), F.sum(F.when(alone, F.col("words")).otherwise(zero)).alias("only_words"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: the base measurements, ``base_failed`` from the two base rules, ``kept`` from the policy ``web/1``."""
    small_batches(spark)
    led = ledger(read_table(spark, sf_dir, "documents"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(F.col("failed"), "base/1")).alias("base_failed"), (passes(F.col("failed"), "base/1") & passes(F.col("failed"), "web/1")).alias("kept"), "failed")


def _sql_bits(rules: tuple[Rule, ...] = RULES) -> str:
    return " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(rules))


OP2_ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM t),
v AS (SELECT *, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM w),
r AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS again FROM v),
k AS (SELECT doc_id, again OR coalesce(lag(again, 1) OVER p, false) OR coalesce(lag(again, 2) OVER p, false) AS hit FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, count_if(hit)::BIGINT AS n_repeat_words FROM k GROUP BY doc_id),
m AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS n_letter_bytes,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(list_filter(ws, lambda x: x IN ('|', '/', '>'))) AS n_bar_words FROM t LEFT JOIN n USING (doc_id)),
f AS (SELECT *, ({_sql_bits()})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {mask_of(POLICIES["base/1"])} <> 0 AS base_failed, failed & {mask_of(POLICIES["web/1"])} = 0 AS kept, failed FROM f
"""
