"""JSON that stands somewhere in a text, as a variant whose fields are asked for by path and type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS = ("color_grade", "cut", "speed", "move", "trim_in", "trim_end", "ripple_trim_out", "ripple_trim_in", "ripple_delete", "unknown")


def json_part(text: Column) -> Column:
    """What a fence of one line marked as JSON holds, else everything from the first to the last brace; null without either."""
    fenced = F.regexp_extract(text, "```json(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    has_fence = text.rlike("```json.*?```")
    return F.when(has_fence, F.trim(fenced, F.lit(" \t\r\n"))).when(braces != "", braces)


def strict_json(part: Column) -> Column:
    """The one JSON value that a text is, as a variant; null if it is malformed or something follows.

    The parser stops behind a whole value. What follows one would have to close a list here and an object there, so both take only a text that is one value."""
    listed = F.try_parse_json(F.concat(F.lit("["), part, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), part, F.lit("}")))
    alone = named.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull() & F.try_variant_get(listed, "$[0]", "variant").isNotNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def json_found(text: Column) -> Column:
    """The JSON in a text; null if there is none or it is malformed."""
    return strict_json(json_part(text))


def intent(found: Column, part: Column) -> Column:
    """A struct (status, action, target, params) of the JSON found in a text.

    ``status`` is none, malformed (no JSON), undecodable (a field is missing or of another type), invalid (the action is unknown) or valid. Params are
    numbers by name; an object that holds others is undecodable."""
    action = F.try_variant_get(found, "$.action", "string")
    target = F.try_variant_get(found, "$.target", "string")
    params = F.try_variant_get(found, "$.params", "map<string,variant>")
    kinds = F.transform(F.map_values(params), F.schema_of_variant)
    numbers = F.forall(kinds, lambda k: k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL"))
    strings = F.coalesce(F.schema_of_variant(F.try_variant_get(found, "$.action", "variant")) == "STRING", F.lit(False)) & F.coalesce(F.schema_of_variant(F.try_variant_get(found, "$.target", "variant")) == "STRING", F.lit(False))
    decoded = strings & action.isin(*ACTIONS) & F.coalesce(numbers, F.lit(False))
    status = F.when(part.isNull(), "none").when(found.isNull(), "malformed").when(~F.coalesce(decoded, F.lit(False)), "undecodable").when(action == "unknown", "invalid").otherwise("valid")
    usable = F.coalesce(decoded, F.lit(False))
    values = F.transform_values(params, lambda _, v: F.try_variant_get(v, "$", "double"))
    return F.struct(status.alias("status"), F.when(usable, action).alias("action"), F.when(usable, target).alias("target"), F.when(usable, values).alias("params"))
