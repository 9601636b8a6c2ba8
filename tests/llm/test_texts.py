"""Quality rules, language ID, packing and license scans."""

import re
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, license_scans, packing, quality_rules
from lodestone.llm.queries import QUERIES

from ..conftest import SF

SEP = re.compile(r"[\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b c a b c", "é ü 🙂 # $ |\n\x1c\n\x85", "x\n x\nx \n\nx", "one two three " * 400, "w" * 100_000, "a\x00b <|endoftext|> <|ENDOFTEXT|>. don't DON'T. x…. (hi)) 12.5, K é"]


def words(text):
    return [w for w in SEP.split(text or "") if w]


def measures(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    tri = Counter(zip(ws, ws[1:], ws[2:]))
    hit = set()
    for k in range(len(ws) - 2):
        if tri[tuple(ws[k : k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or "") if ws else 0, dup, len(hit)


def table(spark, texts):
    return spark.createDataFrame([*((i, t, 1, "z") for i, t in enumerate(texts)), (None, "a b", 1, "z"), (3, texts[3], 1, "z")], "doc_id long, text string, n_words int, ids string")


def test_ledger(spark):
    rows = quality_rules.ledger(table(spark, ODD)).collect()
    assert len(rows) == len(ODD) + 2
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(ODD):
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measures(t), i
    assert by[0]["failed"] == by[1]["failed"] == 1
    assert quality_rules.ledger(table(spark, ODD).limit(0)).count() == 0


def test_quality_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_quality_rules"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, *rest = want = measures(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert all(r["kept"] for r in got if r["doc_id"] in good and not r["base_failed"])


def test_ablation(spark):
    led = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    mask = quality_rules.mask_of(quality_rules.POLICIES["web/1"])
    bits = [r["failed"] & mask for r in led.select("failed").collect()]
    for r in quality_rules.ablation(led, "web/1").collect():
        bit = quality_rules.mask_of((r["rule"],))
        assert r["failed_docs"] == sum(bool(b & bit) for b in bits)
        assert r["only_docs"] == sum(b == bit for b in bits)


# ---- language ID


def slow_bits(tree, window):
    """Code length of one byte by walking from the longest context down."""

    def cost(k):
        if k < 0:
            return 1 / 256
        contexts, totals, distinct, grams, counts = tree.levels[k]
        gram = window & ((1 << (8 * (k + 1))) - 1)
        where = np.flatnonzero(contexts == gram >> 8)
        if not len(where):
            return cost(k - 1)
        whole = totals[where[0]] + distinct[where[0]]
        seen = np.flatnonzero(grams == gram)
        return (counts[seen[0]] if len(seen) else distinct[where[0]] * cost(k - 1)) / whole

    return -np.log2(cost(language_id.ORDER))


def test_code_lengths():
    model = language_id.Model({"a": [b"abracadabra " * 3, b"abra"], "b": [b"hocus pocus "]})
    text = b"abra hocus \xffx"
    padded = b"\n" * language_id.ORDER + text
    for k, tree in enumerate(model.trees):
        want = sum(slow_bits(tree, int.from_bytes(padded[i : i + language_id.ORDER + 1], "big")) for i in range(len(text)))
        assert model.code_lengths([text])[0, k] == pytest.approx(want, rel=1e-5)
        assert model.code_lengths([text])[0, k] == pytest.approx(want, rel=1e-5)
    for tree in model.trees:  # a code: the shares of all bytes after a context add up to one at most
        for context in (b"abra", b"\n\n\n\n", b"zzzz"):
            assert np.exp2(-tree.bits(np.arange(256) + (int.from_bytes(context, "big") << 8))).sum() <= 1 + 1e-9
    long = bytes(np.random.default_rng(0).integers(97, 105, language_id._CHUNK * 2 + 17, np.uint8))
    whole = language_id.Model({"a": [b"abcdefgh" * 50]})
    parts = sum(whole.trees[0].bits(np.array([int.from_bytes((b"\n" * 4 + long)[i : i + 5], "big")])).item() for i in range(0, len(long), 9973))
    assert whole.code_lengths([long])[0, 0] > parts


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op4_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    model = language_id.Model({"en": [b"the cat and the dog"], "fr": [b"le chat et le chien"]})
    rows = language_id.identify(table(spark, [*ODD, "12 34 !?", "½ ² _"]).withColumn("lang_pred", F.lit(9)), model).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [by[k] for k in (0, 1, 2, 10, 11)] == ["und"] * 5
    assert by[3] in ("en", "fr")
    assert len(rows) == len(ODD) + 4
    none = language_id.train(table(spark, ODD).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identify(table(spark, ODD), none).collect()} == {"und"}
    assert language_id.identify(table(spark, ODD).limit(0), model).count() == 0


def test_training_ignores_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(language_id.held_out(F.col("doc_id")))
    assert language_id.train(docs).langs == []


# ---- packing


def test_pieces():
    for n in (1, 2, 3, 4095, 4096, 4097, 10000):
        cut = packing.pieces(n)
        assert cut[0][0] == 0
        assert all(a + b == c for (a, b), (c, _) in zip(cut, cut[1:]))
        assert sum(b for _, b in cut) == n
        assert all(b <= 4096 and b & (b - 1) == 0 for _, b in cut)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    texts = [*ODD, *real]
    rows = packing.pack(table(spark, texts)).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        if i == 3:  # stands twice in the table
            continue
        mine = sorted(by[i], key=lambda r: r["start"])
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert b"".join(r["ids"] for r in mine) == struct.pack(f"<{len(want)}I", *want), i
        assert {r["doc_tokens"] for r in mine} == {len(want)}
        assert all(r["bucket"] == r["length"] == len(r["ids"]) // 4 and r["offset"] == 0 for r in mine)
    assert packing.pack(table(spark, texts).limit(0)).count() == 0
    with pytest.raises(ValueError, match="power"):
        packing.pack(table(spark, texts), max_len=1000)


def test_packing_cache_size_changes_nothing():
    texts = [f"alpha beta{k}, gamma{k}. Delta{k % 3}!".encode() for k in range(200)]
    a, b = (packing.WordEncoder(packing.default_tokenizer()) for _ in range(2))
    b.stems.most = 5
    assert [a.encode(t) for t in texts] == [b.encode(t) for t in texts]


def test_packing_query(spark):
    """Every piece of the registered query against the tokenizer's ids of the whole text."""
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    by = {}
    for r in QUERIES["op5_packing"](spark, SF).collect():
        by.setdefault(r["doc_id"], []).append(r)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(by) == len(docs)
    for d in docs:
        want = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(want), 0)
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *want[r["start"] : at]))
        assert at == len(want)


# ---- licenses


def test_patience():
    assert license_scans.increasing([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    a, b = "x the cat sat on the mat y".split(), "the cat on the mat".split()
    pairs = license_scans.patience(a, b)
    assert [a[i] for i, _ in pairs] == b
    assert license_scans.patience([], b) == []
    assert license_scans.patience(["q", "q"], ["q"]) == [(0, 0)]


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    texts = [None, "", mit, f"{mit} é {mit}", gpl.upper(), "The mit of general public", f"{'word ' * 30000}{gpl}", "This work is now licensed under the GNU General Public License version 3", license_scans.TEMPLATES["Apache-2.0-header"][0]]
    got = license_scans.scan(table(spark, texts)).collect()
    by = Counter((r["doc_id"], r["license"]) for r in got)
    assert by == {(2, "MIT"): 1, (3, "MIT"): 4, (4, "GPL-3.0"): 1, (6, "GPL-3.0"): 1, (7, "GPL-3.0"): 1, (8, "Apache-2.0-header"): 1}
    second = max((r for r in got if r["doc_id"] == 3), key=lambda r: r["start"])
    assert texts[3][second["start"] : second["end"]] == mit[:-1]
    assert license_scans.scan(table(spark, texts).limit(0)).count() == 0


def test_license_families(spark):
    """Whole texts, headers and short forms, each under its own name and not under a relative's."""
    from pathlib import Path

    whole = {f"{f.stem}-text": f.read_text() for f in (Path(license_scans.__file__).parent / "licenses").glob("*.txt")}
    assert len(whole) == 18
    short = {
        "MIT": "Licensed under the MIT License",
        "BSD-2-Clause": "distributed under the terms of the BSD 2-Clause License",
        "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
        "CC-BY-4.0": "Licensed under CC BY 4.0",
        "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        "CC0-1.0": "Released under CC0 1.0",
        "GPL-2.0": "available under the GNU General Public License, version 2",
        "LGPL-2.1": "available under the GNU Lesser General Public License v2.1",
        "AGPL-3.0": "SPDX-License-Identifier: AGPL-3.0",
        "MPL-2.0": "Released under the Mozilla Public License 2.0",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
        "Artistic-2.0": "available under the terms of the Artistic License 2.0",
    }
    cases = [(n, f"{'some words before ' * 50}{t} and some after") for n, t in [*whole.items(), *short.items(), *((n, t) for n, (t,) in license_scans.TEMPLATES.items())]]
    edited = whole["BSD-3-Clause-text"].replace("copyright holder", "Example Trust").replace("\n", "\n# ")
    cases += [("BSD-3-Clause-text", edited), (None, "The mit license of general public; licensed under conditions.")]
    got = {}
    for r in license_scans.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert [got.get(i, []) for i in range(len(cases))] == [[n] if n else [] for n, _ in cases[:-1]] + [[]]


def common(a, b):
    """Length of the longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k], row[k + 1])
    return row[-1]


def stated(text, coded):
    """Names of the licenses that some window states, by exhaustive alignment: every window of every lead, then every name, the longest first."""
    ws = [w for w, _, _ in license_scans.tokens(text)]
    out = set()
    for k in range(1, len(ws)):
        cores = [(len(core), core, name) for cs in coded.names.values() for core, name in cs if tuple(ws[k : k + len(core)]) == core]
        if cores:
            _, _, name = max(cores)
            for leads in coded.leads.values():
                for lead in leads:
                    if ws[k - 1] == lead[-1] and any(common(ws[lo:k], lead) >= license_scans.MIN_COVERAGE * len(lead) for lo in range(max(0, k - len(lead) - 2 - len(lead) // 4), k)):
                        out.add(name)
    return out


def test_license_query(spark):
    """The registered query against exhaustive alignment: all documents that name a word of a lead, and each license stated there."""
    coded = license_scans.default_templates()
    got = {}
    for r in QUERIES["op10_license_scans"](spark, SF).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    want = {r["doc_id"]: names for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] and (names := stated(r["text"], coded))}
    assert want
    short = {i: x for i, names in got.items() if (x := {n for n in names if not n.endswith(("-header", "-text"))})}
    assert short == want


def test_license_whole_texts_by_alignment():
    """Whole texts with words changed, dropped and put in, among other words: found if and only if enough words align."""
    r = random.Random(5)
    coded = license_scans.default_templates()
    words = [f"x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    for name in ("MIT-text", "ISC-text", "BSD-2-Clause-text", "Zlib-text", "BSL-1.0-text", "Apache-2.0-header"):
        for share in (0.0, 0.05, 0.1, 0.3):
            body = [w if r.random() >= share else r.choice(words) for w in coded.texts[name]]
            text = " ".join([*r.choices(words, k=40), *body, *r.choices(words, k=40)])
            covered = common(body, coded.texts[name]) / len(body)
            found = {n for n, *_ in license_scans.detect(text, coded, license_scans.MIN_COVERAGE)}
            if covered >= license_scans.MIN_COVERAGE + 0.03:
                assert name in found, (name, share, covered)
            if covered < license_scans.MIN_COVERAGE:
                assert name not in found


def test_many_statements_in_one_text():
    """Time grows with the text, not with its square."""
    import time

    coded = license_scans.default_templates()
    took = []
    for n in (2000, 16000):
        text = "Released under the MIT License. Some words. " * n
        license_scans.detect(text[:5000], coded, license_scans.MIN_COVERAGE)
        began = time.perf_counter()
        assert len(license_scans.detect(text, coded, license_scans.MIN_COVERAGE)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]
