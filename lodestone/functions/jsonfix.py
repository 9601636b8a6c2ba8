"""Reading JSON that a model wrote: cut it out, parse it, and repair what is usually broken. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank, let, strip_fence


def is_json(c: Column) -> Column:
    """Whether a text parses as strict JSON; null does not."""
    return F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False))


def trailing_commas(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r",\s*\}", "}"), r",\s*\]", "]")


def common_repair(c: Column) -> Column:
    """Drop trailing commas and quote bare keys. On valid JSON with ``, word:`` inside a string this does harm."""
    return F.regexp_replace(trailing_commas(c), r"([{,]\s*)([a-zA-Z_]\w*)\s*:", '$1"$2":')


def control_repair(c: Column) -> Column:
    """Escape line feeds, tabs and carriage returns between quotes, taken in pairs as they come; then drop trailing commas."""
    pieces = F.split(c, '"', -1)
    last = F.size(pieces) - 1

    def escaped(x: Column) -> Column:
        for raw, text in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
            x = F.replace(x, F.lit(raw), F.lit(text))
        return x

    return trailing_commas(F.array_join(F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & (i < last), escaped(x)).otherwise(x)), '"'))


def cut_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}`` of an unfenced text; null where there is no such stretch."""

    def of(text: Column) -> Column:
        start, end = F.instr(text, "{"), F.length(text) - F.length(F.substring_index(text, "}", -1))
        found = (start > 0) & F.contains(text, F.lit("}")) & (end >= start)
        whole = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
        return F.when(whole, text).when(found, F.substring(text, start, end - start + 1))

    return F.when(~is_blank(c), let(strip_fence(c), of))


def safe_object(c: Column, legacy: bool = False) -> Column:
    """Strict JSON text of the object in a model's answer, or null.

    The text is tried as it is and repaired only if that fails; ``legacy`` repairs first, which damages some valid texts.
    """

    def valid(x: Column) -> Column:
        return F.when(is_json(x), x)

    def repaired(raw: Column) -> Column:
        return let(common_repair(raw), lambda fixed: F.coalesce(valid(fixed), let(control_repair(fixed), valid)))

    return let(cut_object(c), lambda raw: repaired(raw) if legacy else F.coalesce(valid(raw), repaired(raw)))


def object_or_array(c: Column) -> Column:
    """Strict JSON text that is an object or an array; null otherwise."""
    return F.when(F.regexp_like(F.schema_of_variant(F.try_parse_json(c)), F.lit("^(OBJECT|ARRAY)<")), c)


def serialise(*fields: Column) -> Column:
    """JSON text of an object with these fields; null fields are left out."""
    return F.to_json(F.struct(*fields))


def string_or(c: Column, path: str, default: Column | str) -> Column:
    """The value at a path as text; the default where it is missing or JSON null. An empty text stays empty."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default) if isinstance(default, str) else default)


def has_key(c: Column, key: str) -> Column:
    """Whether an object has a key; a JSON null there counts."""
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def kind_of(c: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``VOID`` (JSON null) or another type name of a JSON text."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(c)), "^[A-Z]+", 0)


def first_item(c: Column) -> Column:
    """An array's first element, or the object itself, as JSON text."""
    return F.when(kind_of(c) == "ARRAY", F.get_json_object(c, "$[0]")).otherwise(c)


def items_array(c: Column) -> Column:
    """Items as an array whether one object or an array was given."""
    return F.when(kind_of(c) == "OBJECT", F.concat(F.lit("["), c, F.lit("]"))).otherwise(c)
