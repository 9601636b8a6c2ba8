"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two, at most ``max_len``: as many full pieces as fit,
then one piece per set bit of the rest, longest first. Pieces of one length form a bucket and every piece is a sequence of its
own, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship, slices, small_batches

END_ID = 2
MAX_LEN = 4096
#: Stems that a Python worker remembers in each of two generations: some 120 MB in all.
_STEMS_KEPT = 300_000
_FLUSH_BYTES = 2 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens, in order; ``max_len`` must be a power of two."""
    out, at = [], 0
    while n - at:
        size = min(max_len, 1 << ((n - at).bit_length() - 1))
        out.append((at, size))
        at += size
    return out


#: Lower-case letters below this are their own normal form and their own lower case.
LATIN_END = "\u0250"
_ID = struct.Struct("<I").pack


def _byte_chars() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class Remembered:
    """A look-up table of bounded size in two generations: a full young one becomes the old one, and what is used returns."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: list[bytes]) -> list[bytes]:
        """Make room, bring back the keys that the old generation knows, and return those that none knows, each once."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = set(keys).difference(young)
        back = {k: old[k] for k in new if k in old}
        young.update(back)
        return [k for k in new if k not in back]


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and cuts at it, so the ids of a text are those of its words one after the other; and
    where a word ends in ASCII marks after an ASCII letter or digit, the tokenizer cuts there too. It lowers case, so A-Z may
    be lowered first, except where a special token could be spelled. Stems are encoded once and looked up after
    that, in a table whose size changes speed and nothing else. A stem of lower-case Latin letters is in normal form and is
    not cut any further, so it goes to the merges of the model without the steps before them.
    """

    #: ASCII marks (without the apostrophe, which may begin a contraction) between a letter or digit and the end of a word.
    MARKS = re.compile(rb"(?<=[a-zA-Z0-9])([!-&(-/:-@\[-`{-~]+)(?=[\x20\x09-\x0D]|\Z)")

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = struct.pack("<I", end_id)
        self.stems = Remembered(_STEMS_KEPT)

    def encode(self, text: bytes | None) -> bytes:
        text = text or b""
        words = (text if b"<|" in text else self.MARKS.sub(rb" \1", text.lower())).split()
        new = self.stems.missing(words)
        if new:
            self._learn(new)
        return b"".join(map(self.stems.young.__getitem__, words)) + self.end

    def _learn(self, stems: list[bytes]) -> None:
        new, young, tokenize = [], self.stems.young, self.tokenizer.model.tokenize
        for x in stems:
            s = x.decode()
            if s.isalpha() and s.islower() and max(s) < LATIN_END:
                young[x] = b"".join([_ID(t.id) for t in tokenize(x.decode("latin-1").translate(BYTE_CHARS))])
            else:
                new.append(x)
        for at in range(0, len(new), 10_000):
            chunk = new[at : at + 10_000]
            for x, e in zip(chunk, self.tokenizer.encode_batch_fast([x.decode() for x in chunk], add_special_tokens=False), strict=True):
                ids = e.ids
                young[x] = struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _packer(path: str, end_id: int, max_len: int):
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = WordEncoder(path, end_id)
        encoder = _encoders[path, end_id]
        for batch in slices(batches):
            kind, ids, rows, held = batch.schema.field(0).type, [], [[], [], [], []], 0

            def flush(kind=kind):
                return pa.RecordBatch.from_arrays([pa.array(rows[0], kind), *(pa.array(x, pa.int64()) for x in rows[1:]), pa.array(ids, pa.binary())], names=names)

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                coded = encoder.encode(text.as_py())
                n = len(coded) // 4
                for start, length in pieces(n, max_len):
                    for x, v in zip(rows, (doc, start, length, n), strict=True):
                        x.append(v)
                    ids.append(coded[4 * start : 4 * (start + length)])
                held += len(coded)
                if held > _FLUSH_BYTES:
                    yield flush()
                    ids, rows, held = [], [[], [], [], []], 0
            if ids:
                yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), bucket, sequence_id, offset.

    ``bucket`` is the length of the piece; its sequence holds this one piece at offset 0. ``tokenizer`` must cut at white
    space and drop it. A null or empty text is the end id alone. A null id stays null, repeated rows are packed each for
    itself, an empty table gives no pieces, other columns are not read. Nothing is shuffled and no document meets another,
    so a lost executor costs its own partitions.
    """
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    out = slim.mapInArrow(_packer(tokenizer or default_tokenizer(), end_id, max_len), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")
    return out.withColumns({"bucket": F.col("length"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed pieces as one Parquet folder per bucket, for readers that batch equal lengths; no shuffle."""
    packed.write.partitionBy("bucket").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    packed = pack(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
