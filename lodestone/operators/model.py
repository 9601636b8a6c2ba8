"""The seam to a language model, and a deterministic stand-in for tests.

A model answers four questions on columns; answers are JSON text, null where it fails. The stand-in is made of native
expressions. ``CallModel`` wraps a Python client: its calls cost money and may differ from one to the next, so it is marked
non-deterministic, and callers write its answers once (``ingest.run`` does) before anything reads them twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.text import head


class Model(Protocol):
    def header(self, text: Column) -> Column: ...
    def triage(self, text: Column) -> Column: ...
    def extract(self, text: Column, category: Column) -> Column: ...
    def narrate(self, items: Column, category: Column) -> Column: ...


#: Cues of the stand-in, of our own choice; a caller may give others.
HINTS: dict[str, tuple[str, ...]] = {
    "Tenders": ("sealed tender", "quotation for", "supply and delivery"),
    "Land_Property": ("parcel of land", "land registrar", "plot number"),
    "Court_Legal": ("high court", "estate of the late", "petitioner"),
    "Company_Registrations": ("companies act", "registrar of companies", "struck off the register"),
}


class StubModel:
    """Rules instead of a model. The category comes from hint words; extraction and narrative restate the text."""

    def __init__(self, hints: dict[str, tuple[str, ...]] | None = None):
        self.hints = hints or HINTS

    def header(self, text: Column) -> Column:
        seen = head(text, S.HEADER_CHARS)
        volume, number, date = (F.regexp_extract(seen, p, 0) for p in (r"Vol\. [A-Z]+", r"No\. \d+", r"\d{4}-\d{2}-\d{2}"))
        return F.to_json(F.struct(volume.alias("gazetteVolume"), number.alias("gazetteNumber"), date.alias("gazetteDate")))

    def triage(self, text: Column) -> Column:
        seen = F.lower(head(text, S.TRIAGE_CHARS))
        out: Column = F.lit(S.DEFAULT_CATEGORY)
        for category, words in reversed(self.hints.items()):
            found = F.lit(False)
            for w in words:
                found = found | F.contains(seen, F.lit(w))
            out = F.when(found, category).otherwise(out)
        return out

    def extract(self, text: Column, category: Column) -> Column:
        item = F.struct(F.nullif(F.regexp_extract(text, S.NOTICE_NUMBER, 1), F.lit("")).alias("notice_id"), text.alias("brief_text"))
        return F.when(F.length(text) > 0, F.to_json(F.struct(item.alias("items"))))

    def narrate(self, items: Column, category: Column) -> Column:
        brief = F.coalesce(F.get_json_object(items, "$.brief_text"), F.get_json_object(items, "$[0].brief_text"), F.lit(""))
        return F.to_json(F.struct(F.concat(category, F.lit(" notice")).alias("title"), brief.alias("summary"), brief.alias("article"), head(brief, S.X_SUMMARY_CHARS).alias("xSummary"), F.lit("").alias("actionableInfo"), (F.length(brief) % 10 + 1).alias("significance")))


class CallModel:
    """A client as a model: ``ask(step, inputs)`` answers a batch of prompts' inputs; see ``patient`` for retries and pauses.

    A row whose first input is null is not asked for, and its answer is null.
    """

    def __init__(self, ask: Callable[[str, list[tuple[str | None, ...]]], list[str | None]]):
        self.ask = ask

    def _call(self, step: str, *cols: Column) -> Column:
        ask = self.ask

        @F.pandas_udf("string")
        def answer(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for p in parts:
                rows = [tuple(None if x is pd.NA or x != x else x for x in r) for r in zip(*p, strict=True)]
                asked = [k for k, r in enumerate(rows) if r[0] is not None]
                out: list[str | None] = [None] * len(rows)
                if asked:
                    for k, x in zip(asked, ask(step, [rows[k] for k in asked]), strict=True):
                        out[k] = x
                yield pd.Series(out, dtype=object)

        # a struct of one keeps the iterator-of-tuples form for any number of inputs
        return answer.asNondeterministic()(*(cols if len(cols) > 1 else (cols[0], F.lit(step))))

    def header(self, text: Column) -> Column:
        return self._call("header", head(text, S.HEADER_CHARS))

    def triage(self, text: Column) -> Column:
        return self._call("triage", head(text, S.TRIAGE_CHARS))

    def extract(self, text: Column, category: Column) -> Column:
        return self._call("extract", text, category)

    def narrate(self, items: Column, category: Column) -> Column:
        return self._call("narrate", items, category)


def patient(ask: Callable[[str, list[tuple[str | None, ...]]], list[str | None]], attempts: int = 3, first_pause: float = 2.0, between: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, list[tuple[str | None, ...]]], list[str | None]]:
    """``ask`` with a call policy: after a failure it pauses, twice as long each time, up to ``attempts`` calls; then, and at once
    where permission is denied, the inputs' answers are null. ``between`` is the pause before each batch, to spare the service.
    """

    def call(step: str, inputs: list[tuple[str | None, ...]]) -> list[str | None]:
        sleep(between)
        pause = first_pause
        for k in range(attempts):
            try:
                return ask(step, inputs)
            except PermissionError:
                break
            except Exception:  # noqa: BLE001 - whatever a client raises counts as a failed call
                if k + 1 < attempts:
                    sleep(pause)
                    pause *= 2
        return [None] * len(inputs)

    return call
