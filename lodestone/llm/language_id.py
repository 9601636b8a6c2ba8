"""Language identification by prediction by partial matching over bytes.

Per language, a context tree of the orders 0 to ``ORDER`` is counted on a bounded sample and then frozen. A byte costs, in the
longest context that the tree knows, -log2 of its share if it was seen there, else the cost of the escape plus its cost in
the next shorter context, down to the uniform order below 0; the escape has the weight of the distinct bytes of the context
(method C). A text goes to the language with the shortest code.

The cost depends on the last ``ORDER + 1`` bytes alone. So each distinct window is worked out once, exactly, and kept in a
direct-mapped table; a text's code length is a sum of look-ups. The table is a cache: its size changes speed, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, read_table, ship, slices, small_batches

ORDER = 4
#: The bound of the training sample: so many whole documents and bytes of each language, and so many languages, the commonest.
SAMPLE_DOCS = 300
SAMPLE_BYTES = 4 << 20
MAX_LANGS = 256
#: Labels up to this many are broadcast with their counts.
BROADCAST_LANGS = 10_000
UNKNOWN = "und"
#: Bits that a byte of a known language costs at most, but for names, numbers and the like.
CHEAP = 5.0
_SLOTS = 1 << 19
_CHUNK = 1 << 18
_PAD = b"\n" * ORDER


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 0 modulo 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Tree:
    """Frozen counts of one language: for each order, sorted context codes with their totals and distinct bytes, and sorted grams."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        data = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8).astype(np.int64)
        real = np.ones(len(data), bool)
        at = 0
        for t in texts:
            real[at : at + len(_PAD)] = False
            at += len(_PAD) + len(t)
        self.levels = []
        for k in range(order + 1):
            codes = np.zeros(len(data), np.int64)
            for j in range(k + 1):
                codes[j:] |= data[: len(data) - j] << (8 * j)
            grams, counts = np.unique(codes[real], return_counts=True)
            contexts, first = np.unique(grams >> 8, return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            distinct = np.diff(np.append(first, len(grams)))
            self.levels.append((contexts, totals.astype(np.float64), distinct.astype(np.float64), grams, counts.astype(np.float64)))

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of each window, given the bytes before it."""
        p = np.full(len(windows), 1 / 256)
        for k, (contexts, totals, distinct, grams, counts) in enumerate(self.levels):
            if not len(grams):
                continue
            gram = windows & ((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(contexts, gram >> 8), len(contexts) - 1)
            known = contexts[at] == gram >> 8
            g = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            seen = grams[g] == gram
            whole = totals[at] + distinct[at]
            p = np.where(known, np.where(seen, counts[g], distinct[at] * p) / whole, p)
        return -np.log2(p)


class Model:
    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.order = order
        self.langs = sorted(samples)
        self.trees = [Tree(samples[lang], order) for lang in self.langs]
        self._keys: np.ndarray | None = None

    def _window_bits(self, windows: np.ndarray) -> np.ndarray:
        if self._keys is None:
            self._keys, self._costs = np.full(_SLOTS, -1, np.int64), np.zeros((_SLOTS, len(self.langs)))
        slots = ((windows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 19)).astype(np.int64)
        out = self._costs[slots]
        miss = np.flatnonzero(self._keys[slots] != windows)
        if len(miss):
            fresh, back = np.unique(windows[miss], return_inverse=True)
            costs = np.stack([t.bits(fresh) for t in self.trees], axis=1)
            out[miss] = costs[back]
            at = slots[miss]
            self._keys[at] = windows[miss]
            # of windows that share a slot numpy keeps the last; costs follow the key that stayed
            stayed = self._keys[at] == windows[miss]
            self._costs[at[stayed]] = out[miss][stayed]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language: one row per text."""
        return self._coded(texts)[0]

    def _coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each whole text under each language, and its bytes that cost at most ``CHEAP`` bits."""
        total, cheap = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs)), np.int64)
        parts: list[tuple[int, bytes, bytes]] = []
        held = 0

        def settle() -> None:
            data = np.frombuffer(b"".join(a + b for _, a, b in parts), np.uint8).astype(np.int64)
            windows = np.zeros(len(data), np.int64)
            for j in range(self.order + 1):
                windows[j:] |= data[: len(data) - j] << (8 * j)
            bits = self._window_bits(windows)
            at = 0
            for row, a, b in parts:
                own = bits[at + len(a) : at + len(a) + len(b)]
                total[row] += own.sum(axis=0)
                cheap[row] += np.count_nonzero(own <= CHEAP, axis=0)
                at += len(a) + len(b)

        for row, text in enumerate(texts):
            for start in range(0, len(text), _CHUNK):
                parts.append((row, (_PAD + text[max(0, start - self.order) : start])[-self.order :], text[start : start + _CHUNK]))
                held += len(parts[-1][2]) + self.order
                if held >= _CHUNK:
                    settle()
                    parts, held = [], 0
        if parts:
            settle()
        return total, cheap

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[float]]:
        """Language, score in 0..1 (the posterior under equal priors), bits per byte and share of cheap bytes; ``und``, 0, 0, 0
        without a letter.
        """
        rows = [k for k, t in enumerate(texts) if t and has_letter(t)]
        lang, score, rate, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if rows and self.langs:
            coded = [texts[k].encode() for k in rows]
            bits, cheap = self._coded(coded)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(rows)), best]
            post = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
            for i, (k, b, s, x, c) in enumerate(zip(rows, best, post, least, coded, strict=True)):
                lang[k], score[k], rate[k], known[k] = self.langs[b], float(s), float(x) / len(c), float(cheap[i, b]) / len(c)
        return lang, score, rate, known


_LATIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def has_letter(text: str) -> bool:
    return any(c in _LATIN or c.isalpha() for c in text)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = SAMPLE_DOCS, bytes_per_lang: int = SAMPLE_BYTES, max_langs: int = MAX_LANGS) -> Model:
    """Fit on at most ``docs_per_lang`` whole documents and ``bytes_per_lang`` bytes of each language, none of them held out.

    The sample is drawn by a hash of the id and the text, so reruns agree; in its order it ends where the bytes
    would be passed. Rows without text or language teach nothing. Of more than ``max_langs`` labels the commonest are
    learned, of equally common ones the first by code point: the model and the driver hold a bounded sample for each.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    labelled = docs.where(lang.isNotNull() & text.isNotNull() & ~held_out(F.col(id_col))).select(lang.cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.lit(17), F.col(id_col), text).alias("h"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    draw = F.shiftrightunsigned("h", 11) * F.lit(2.0**-53)
    likely = labelled.where(F.octet_length("text") <= bytes_per_lang).join(broadcast_if_small(counts, BROADCAST_LANGS), "lang").where(draw < 2.0 * docs_per_lang / F.col("n"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    place, size = F.row_number().over(order), F.sum(F.octet_length("text")).over(order)
    rows = likely.withColumns({"place": place, "size": size}).where((F.col("place") <= docs_per_lang) & (F.col("size") <= bytes_per_lang)).select("lang", "place", "text").collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return Model(samples)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with ``lang_pred``, ``lang_score``, and under the predicted language ``lang_bits`` (per byte) and
    ``lang_known`` (the share of bytes that cost at most ``CHEAP`` bits).

    The text alone decides. A null text, or one without a letter, gets ``und`` with score 0; a tie goes to the first language
    by code point. Other columns are kept, these four are replaced; repeated rows, null ids and an empty table need no care.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "lang_score", "lang_bits", "lang_known")
    names = base.columns
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in slices(batches):
            lang, *figures = mine.predict(batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in figures)], names=[*names, "lang_pred", "lang_score", "lang_bits", "lang_known"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_bits", DoubleType()), StructField("lang_known", DoubleType())])
    return base.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
