"""Secret scans: base patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, the other on ordinary identifiers and words; a token is a secret if the first explains
its best stretch better by ``MIN_RATIO`` nats, so the words of a path do not outvote a secret behind them. Scoring is a fold over a token's characters with the difference of the two tables as a literal.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: kind -> (pattern, group that counts, its least length); kinds in the order in which they are listed
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = (*BASE, "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Tokens that the models score: runs of the alphabet of at least so many characters. Set by false positives, see the README.
MIN_TOKEN = 10
MIN_RATIO = 12.0
_TOKEN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN
#: Labelled samples of each kind that the models see; the bound of the training set.
SAMPLES = 4000
_BLOCK = 128


def labelled_samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, str]]:
    """(label, token): ``random`` strings over the usual alphabets, and ``ordinary`` identifiers, paths, numbers and words of four languages."""
    r = random.Random(seed)
    stems = "get set user name item list page index content main data file path time date count total order price image video search result value default config module package version release update section article chapter table figure house water garden street number letter country people history science market summer winter".split()
    syllables = "an en er in on re th st ti le de la es ou nd ed ion ent ing ver ber gen ach sch ein cha per tra pro con que men tri".split()
    prose = (
        "the which where when while whose with without through though thought that this these those other another should would could whether weather nothing something everything anything somewhere although together health wealth strength knowledge judgment themselves ourselves yourself husband household friendship shall shown shadow should wishes washing where whole white length "
        "heureux deux eaux aux mieux lieux yeux jeux feux nouveaux beaux cheveux ceux eux nombreux elle quelle laquelle celle quelque lorsque puisque jusque aujourd oui ou vous nous toujours jour pouvoir savoir avoir faire leurs auxquels travaux niveaux journaux "
        "nicht schon zwischen durch wirklich geschichte gesellschaft rechtsschutzversicherung wirtschaft arbeitsplatz jahrhundert entwicklung schwierig verhalten sprache heissen zurueck moeglich zwoelf pflicht hoffnung abfall herz sitzung anspruch "
        "hermano carro desarrollo ahora mayor trabajo mejor derecho gobierno ciudad mujer nosotros ejemplo siempre quizas hacia llegar llamar aquellos izquierda guerra rojo dibujo paisaje sociedad mismos osos oscuro"
    ).split()
    hexes, lower, both = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62]
    out = []
    for _ in range(n):
        alphabet = r.choice((hexes, hexes.upper(), lower, lower.upper(), both, both, ALPHABET[:64]))
        out.append(("random", "".join(r.choice(alphabet) for _ in range(r.randint(20, 64)))))
        words = [r.choice(stems) for _ in range(r.randint(2, 6))]
        number = str(r.randint(0, 10 ** r.randint(1, 16)))
        shape = r.randrange(12)
        if shape == 0:
            word = "_".join(words) + "_" + number
        elif shape == 1:
            word = words[0] + "".join(w.capitalize() for w in words[1:]) + r.choice(("", number))
        elif shape == 2:
            word = "/".join(words) + "/" + number
        elif shape == 3:
            word = "-".join([*words, number])
        elif shape == 4:
            word = "".join(r.choice(syllables) for _ in range(r.randint(5, 12)))
        elif shape == 5:
            word = f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}_{number}"
        elif shape == 6:
            word = "_".join(words).upper()
        elif shape < 11:
            word = r.choice((str, str.capitalize, str.upper))("".join(r.choice(prose) for _ in range(r.randint(1, 4))))
        else:
            word = "".join(str(r.randrange(10)) for _ in range(r.randint(8, 30)))
        out.append(("ordinary", word))
    return out


def train(samples: list[tuple[str, str]]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for all pairs of the alphabet, row by row, with add-one counts."""
    n = len(ALPHABET)
    at = {c: k for k, c in enumerate(ALPHABET)}
    counts = {label: [[1.0] * n for _ in range(n)] for label in ("random", "ordinary")}
    for label, token in samples:
        for a, b in zip(token, token[1:]):
            if a in at and b in at:
                counts[label][at[a]][at[b]] += 1
    logs = {label: [[math.log(x / sum(row)) for x in row] for row in table] for label, table in counts.items()}
    return [logs["random"][a][b] - logs["ordinary"][a][b] for a in range(n) for b in range(n)]


@lru_cache(maxsize=1)
def default_model() -> tuple[float, ...]:
    return tuple(train(labelled_samples()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(lengths: Column) -> Column:
    """For each item of an array of longs, the sum of those before it; in blocks, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")

    def add(a: Column, b: Column) -> Column:
        return a + b

    def over(arr: Column) -> Column:
        n = F.size(arr)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda s: F.aggregate(F.slice(arr, s + 1, F.lit(_BLOCK)), zero, add))
        first = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("all"))
        bases = F.aggregate(blocks, first, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")), lambda acc: acc["all"])
        return let(bases, lambda base: F.transform(arr, lambda _, i: F.element_at(base, (i / _BLOCK).cast("int") + 1) + F.aggregate(F.slice(arr, (i - i % _BLOCK) + 1, i % _BLOCK), zero, add)))

    return let(lengths, over)


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,token:string>>"


def find(text: Column, pattern: str, kind: int) -> Column:
    """All matches, leftmost and not overlapping, with code-point spans: the text between two matches and the matches add up."""

    def spans(m: Column) -> Column:
        between = F.split(text, pattern, -1)
        gaps = F.transform(F.slice(between, F.lit(1), F.size(m)), lambda x: F.length(x).cast("long"))
        sizes = F.transform(m, lambda x: F.length(x).cast("long"))
        steps = F.zip_with(gaps, sizes, lambda a, b: a + b)
        return let(sizes, lambda own: F.zip_with(let(F.zip_with(sums_before(steps), gaps, lambda a, b: a + b), lambda s: F.zip_with(s, own, lambda a, b: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + b).alias("end")))), m, lambda s, t: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), t.alias("token"))))

    empty = F.array().cast(_SPAN)
    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans).cast(_SPAN)).otherwise(empty)


def ratio(token: Column, table: tuple[float, ...]) -> Column:
    """Log-likelihood ratio of a token of the alphabet, random against ordinary, over the character pairs of its best stretch."""
    n = len(ALPHABET)
    values = F.array(*(F.lit(x) for x in table))
    places = F.transform(F.filter(F.split(token, "", -1), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(acc: Column, k: Column) -> Column:
        gain = F.when(acc["last"] >= 0, F.element_at(values, acc["last"] * n + k + 1)).otherwise(0.0)
        total = F.greatest(acc["sum"] + gain, F.lit(0.0))
        return F.struct(k.alias("last"), total.alias("sum"), F.greatest(acc["best"], total).alias("best"))

    return F.aggregate(places, start, step, lambda acc: acc["best"])


def _long_enough(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    return lambda x: F.length(F.regexp_extract(x["token"], pattern, group) if group else x["token"]) >= least


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == k


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[float, ...] | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per input row: ``doc_id`` and ``found``, an array of (start, kind, end, token) by start and then kind.

    Spans are code points of the whole text, end exclusive; kind is the place in ``KINDS``. Base matches that are too short
    are dropped, all others stay; a Markov span that overlaps a base span is left out. A null or empty text has none, null
    ids and repeated rows stay as they are, an empty table gives no rows; other columns are not read.
    """
    table = tuple(model) if model is not None else default_model()
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = []
    for k, (name, (pattern, group, least)) in enumerate(BASE.items()):
        out = out.withColumn(name, F.filter(find(F.col("text"), pattern, k), _long_enough(pattern, group, least)))
        parts.append(F.col(name))
    out = out.withColumn("base", F.concat(*parts))
    free = F.filter(find(F.col("text"), _TOKEN, len(BASE)), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    out = out.withColumn("markov", F.filter(free, lambda x: ratio(x["token"], table) >= min_ratio))
    return out.select("doc_id", F.array_sort(F.concat("base", "markov")).alias("found"))


def _digest(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, token): one row per span, for review or masking."""
    each = scan(docs, id_col, text_col).select("doc_id", F.explode("found").alias("x"))
    names = F.array(*(F.lit(k) for k in KINDS))
    return each.select("doc_id", F.element_at(names, F.col("x.kind") + 1).alias("kind"), "x.start", "x.end", "x.token")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *count, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"))
