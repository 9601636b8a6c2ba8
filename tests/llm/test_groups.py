"""N-gram join, embedding dedup, components and the pipeline, all against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, graph, language_id, ngram_join
from lodestone.llm.queries import QUERIES

from ..conftest import SF
from .test_texts import words


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 200)] + [(k, k + 1) for k in range(5000, 5100)] + [(7, 7), (9, None)]
    u = Union()
    for a, b in edges:
        if b is not None:
            u.join(a, b)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- n-gram join


def shingles(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def joined(rows):
    """rows: (id, text). n_shingles and component of each id, over all pairs that share a shingle."""
    sets, u, seen = [shingles(t) for _, t in rows], Union(), {}
    for k, s in enumerate(sets):
        common = {}
        for x in s:
            for j in seen.get(x, ()):
                common[j] = common.get(j, 0) + 1
            seen.setdefault(x, []).append(k)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                u.join(rows[j][0], rows[k][0])
    return {i: (len(s), u.find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def check_join(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, tile string, n int")
    got = ngram_join.components_of(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == joined(rows)


def variants(r, base, count, edits):
    for _ in range(count):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        yield " ".join(w)


def test_join(spark):
    r = random.Random(1)
    rows = list(enumerate([None, "", " \n", "A b", "a B", "a b", "one two three four FIVE", "one two three four five", "é É x y z", "long " * 30000]))
    for size in (6, 9, 12, 20, 60, 200, 700):
        for _ in range(4):
            base = [f"w{r.randrange(10**6)}" for _ in range(size)]
            rows += [(len(rows) + k + 100, t) for k, t in enumerate(variants(r, base, 8, max(1, size // 25)))]
    passage = [f"p{k}" for k in range(60)]
    rows += [(5000 + k, " ".join([*passage, *(f"q{r.randrange(10**6)}" for _ in range(r.randint(10, 80)))])) for k in range(60)]
    check_join(spark, rows)


def test_join_over_blocks(spark, monkeypatch):
    """Clusters of many blocks, without leaders that join them: the closing step finds every link that is left."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "LEADERS", 0)
    monkeypatch.setattr(ngram_join, "TILE_BLOCK", 8)
    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = list(enumerate(variants(r, base, 60, 12)))
    check_join(spark, rows)


def test_join_over_blocks_with_shared_ids(spark, monkeypatch):
    """Rows that share an id and not a text: each text's links count, in clusters of many blocks too."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "LEADERS", 0)
    r = random.Random(7)
    one, two = [f"w{k}" for k in range(150)], [f"u{k}" for k in range(60)]
    rows = list(enumerate(variants(r, one, 20, 12))) + [(k + 5, t) for k, t in enumerate(variants(r, two, 20, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = joined(rows)
    got = {(x["doc_id"], x["component_id"]) for x in ngram_join.components_of(docs).collect()}
    assert got == {(i, c) for i, (_, c) in want.items()}


def test_join_below_threshold(spark, monkeypatch):
    """Many documents that share a passage and stay below the threshold: the pairs that leave the tiles don't grow with their square."""
    emitted = []
    whole = ngram_join.written

    def counted(df, name):
        out = whole(df, name)
        if name == "pairs":
            emitted.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    r = random.Random(12)
    passage = [f"p{k}" for k in range(200)]
    # a similarity near 0.65 within each pair, and two real copies
    texts = [" ".join([*passage, *(f"q{r.randrange(10**9)}" for _ in range(48))]) for _ in range(4000)]
    texts += [texts[0] + " more", texts[1] + " more"]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.components_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(4000)}, 4000: 0, 4001: 1}
    assert emitted and max(emitted) < 4000


def test_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_DOCS", 0)
    rows = list(enumerate(["a b c d e f"] * 3 + ["a b c d e f g h i j k l", "a b c d e f g h i j k l m"]))
    check_join(spark, rows)


def test_join_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.components_of(docs).collect()), key=str)
    assert got == [(-1, 2, None), (2, 2, 2), (4, 2, 2), (4, 2, 2)]
    assert ngram_join.components_of(docs.limit(0)).count() == 0


def test_bound_and_miss():
    assert (1 - 0.8**ngram_join.ROWS) ** ngram_join.BANDS < 1e-9
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 2**63, 400, np.uint64))
    b = np.unique(np.concatenate([a[:300], r.integers(0, 2**63, 80, np.uint64)]))
    both = len(np.intersect1d(a, b))
    for bits in (256, 2048, 1 << 18):
        x, y = ngram_join.bitmap(a, bits), ngram_join.bitmap(b, bits)
        assert (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2 >= both
        assert (ngram_join.halved(x) == ngram_join.bitmap(a, bits // 2)).all()


def test_bounded_pairs():
    """Of every two sets that reach the similarity, with bitmaps of one or two lengths, the pair passes the bound, and once."""
    r = np.random.default_rng(6)
    sets = []
    for size in (5, 30, 60, 63, 64, 66, 500, 510, 515, 3000):
        base = r.integers(0, 2**63, size, np.uint64)
        for _ in range(6):
            s = base.copy()
            s[: r.integers(0, size // 4 + 1)] = r.integers(0, 2**63, 1, np.uint64)[0]
            sets.append(np.unique(np.concatenate([s, r.integers(0, 2**63, r.integers(0, size // 5 + 1), np.uint64)])))
    n = len(sets)
    node, size = np.arange(n), np.array([len(s) for s in sets])
    comp, maps = node.copy(), [ngram_join.bitmap(s, ngram_join.bits_of(len(s))) for s in sets]
    # all are outsiders: each stands on both sides
    every = np.ones(n, bool)
    got = [(int(node[i]), int(node[j])) for i, j in ngram_join.near_pairs(every, every, every, node, comp, size, maps)]
    few = [i for i, _ in ngram_join.near_pairs(every, every, every, node, comp, size, maps, best=2)]
    assert max(map(few.count, few)) <= 4  # two with either length of bitmaps
    true = {(a, b) for a in range(n) for b in range(a) if ngram_join.enough(sets[a], sets[b])}
    assert len(got) == len(set(got)) and {(max(p), min(p)) for p in got} >= true
    assert any(len(maps[a]) != len(maps[b]) for a, b in true)


def test_join_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op7_ngram_join"](spark, SF).collect()}
    assert got == joined(rows)


# ---- embeddings


def linked(vectors):
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    u, links = Union(), {i: 0 for i, _ in vectors}
    for k, (i, x) in enumerate(good):
        for j, y in good[:k]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    return links, u


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        c = r.normal(size=16)
        rows += [(c + r.normal(size=16) * 0.12).tolist() for _ in range(r.integers(1, 12))]
    rows += [rows[0]] * 30 + [[2 * x for x in rows[1]], [0.0] * 16, None, [], [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 0.0], [1.0, 0.1], [-0.0, 1.0]]
    vectors = list(enumerate(rows))
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in vectors] + [(None, rows[0], 0, 0)], "vec_id long, embedding array<double>, label int, node int")
    got = embedding_dedup.near_duplicates(df, cell_rows=32).collect()
    assert len(got) == len(rows) + 1
    links, u = linked(vectors)
    for x in got:
        i = x["vec_id"]
        if i is None:
            assert (x["n_links"], x["component_id"], x["kept"]) == (0, None, True)
        else:
            assert (x["n_links"], x["component_id"], x["kept"]) == (links[i], u.find(i), u.find(i) == i), i
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall(spark):
    """Centres in numbers as in production, on vectors of 64 numbers; found links against all links."""
    r = np.random.default_rng(9)
    c = r.normal(size=(150, 64))
    x = np.repeat(c, 10, axis=0) + r.normal(size=(1500, 64)) * 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = int((n @ n.T >= 0.9).sum() - len(x))
    found = embedding_dedup.near_duplicates(df, cell_rows=50).agg(F.sum("n_links")).first()[0]
    assert true > 5000
    assert 0.99 * true <= found <= true


def test_embedding_links_over_many_cells(spark):
    """Vectors without clusters, each with a partner just over the threshold, in 300 cells: no link is lost or counted twice."""
    r = np.random.default_rng(10)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = r.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = r.uniform(0.901, 0.92, (len(x), 1))
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * away])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, cell_rows=20, sigmas=None).collect()}
    assert got == {i: (1, i % len(x)) for i in range(len(both))}


@pytest.mark.parametrize("spread", [64, 12])
def test_embedding_recall_over_a_thousand_cells(spread):
    """Pairs at the threshold, over 1,000 cells, in vectors that fill all or few dimensions: the usual reach keeps nearly all."""
    r = np.random.default_rng(11)

    def draw(n):
        y = r.normal(size=(n, 64)) * np.exp(-np.arange(64) / spread)
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    sample = draw(12_000)
    c = embedding_dedup.fit({64: sample}, {64: 1000})[64]
    reach = embedding_dedup.reach_of(sample, 0.9, embedding_dedup.SIGMAS)
    u, w = draw(4000), draw(4000)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.9 * u + np.sqrt(0.19) * w
    (hu, gu), (hv, gv) = embedding_dedup._seats(u, c, reach), embedding_dedup._seats(v, c, reach)
    k = np.arange(len(u))
    assert (hu != hv).mean() > 0.2
    assert ((hu == hv) | gu[k, hv] | gv[k, hu]).mean() > 0.99
    assert gu.sum(axis=1).mean() < 250


def test_embedding_query(spark):
    """The registered query, over its whole table, against all pairs."""
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links, u = linked(vectors)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op9_embedding_dedup"](spark, SF).collect()}
    assert got == {i: (links[i], u.find(i), u.find(i) == i) for i, _ in vectors}


# ---- pipeline


def test_language_stage_keeps_prose_and_drops_noise(spark):
    """Texts with keys, numbers and shouting stay; null, letterless and random ones go."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(3)
    words = docs.where("lang = 'en'").orderBy("doc_id").first()["text"].split()
    key = "".join(r.choice("0123456789abcdef") for _ in range(40))
    good = [f'token = "{key}" ' + " ".join(words[:8]), " ".join(words[:6]) + f" password={key[:18]} " + words[7], " ".join(words[:20]).upper() + "!!", words[0]]
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(40)), "".join(r.choice("qwrtzpsdfghjklyxcvbnmQWRTZ0123456789+/") for _ in range(400)), "12 34 !!", "", None]
    extra = spark.createDataFrame([(50_000 + k, t, None, "src0", 0) for k, t in enumerate([*good, *noise])], docs.schema)
    kept = {r["doc_id"] for r in cp.keep_known_languages(spark, docs.unionByName(extra), SF).select("doc_id").collect()}
    assert {i for i in kept if i >= 50_000} == {50_000 + k for k in range(len(good))}
    assert kept >= {r["doc_id"] for r in docs.collect() if language_id.has_letter(r["text"] or "")}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_000, None, "en", "src0", 0), (10_001, "12345 !!", "en", None, 8), (10_002, "", None, "src1", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(docs.limit(2))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r["doc_id"], r["text"]) for r in at.collect()]
    assert not {10_000, 10_001, 10_002} & {i for i, _ in kept["language_id"]}
    assert len(kept["language_id"]) == docs.count() - 3
    assert sorted(i for i, _ in kept["line_dedup"]) == sorted(i for i, _ in kept["language_id"])
    comps = joined(sorted(set(kept["line_dedup"]), key=str))
    assert sorted(i for i, _ in kept["ngram_join"]) == sorted({c for i, (_, c) in comps.items()})
    assert {i for i, _ in kept["mixing"]} <= {i for i, _ in kept["ngram_join"]}
    packed = cp.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in kept["mixing"]})
    assert len(cp.STAGES) == 5
    own = ["lang_pred", "lang_bits", "mix_rate", "mix_key", "__mine", "plan", "n_lines", "node", "component_id", "H1", "other_9"]
    odd = docs.where("doc_id < 150").select("doc_id", *(F.concat_ws("-", "doc_id", F.lit(k)).alias(c) for k, c in enumerate(own)), *docs.columns[1:])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        assert all(r[c] == f"{r['doc_id']}-{k}" for r in out.collect() for k, c in enumerate(own)), name
    assert cp.STAGES[-1][1](spark, odd, str(tmp_path)).count() > 0
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
