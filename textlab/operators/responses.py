"""Validated parsing of model responses held in a table column.

Steps, as Column expressions: strip a ``` fence; parse the text as JSON; a
JSON string is unwrapped and parsed again; otherwise the first ``{...}`` span
is parsed; anything that does not yield an object gives an empty result.
Enum fields are coerced to their allowed values, with defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import _c

FENCE_RE = f"(?m)^```(?:json)?{P.WS}*|{P.WS}*```$"


def strip_fence(raw) -> Column:
    """Remove a leading/trailing ``` fence when the text starts with one."""
    t = F.trim(_c(raw))
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(t, FENCE_RE, ""))).otherwise(t)


def _object(text: Column) -> Column:
    """Variant of ``text`` when it parses to a JSON object, else null."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _unwrapped(text: Column) -> Column:
    """If ``text`` is a JSON string, its content (fence-stripped), else null."""
    v = F.try_parse_json(text)
    inner = F.variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "STRING", strip_fence(inner))


def response_object(raw) -> Column:
    """Variant holding the parsed JSON object, or null."""
    text = strip_fence(raw)
    direct = F.coalesce(_object(text), _object(_unwrapped(text)))
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    span = F.when(span != "", span)
    from_span = F.coalesce(_object(span), _object(_unwrapped(span)))
    return F.coalesce(direct, from_span)


def coerce(value: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def parse_responses(df: DataFrame, raw_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Adds intent / escalation / reason (coerced) and confidence (double,
    default 0.0) and ``parsed`` (an object was found)."""
    obj = response_object(raw_col)
    d = P.RESPONSE_DEFAULTS
    get_s = lambda f: F.try_variant_get(obj, f"$.{f}", "string")
    return df.select(
        *keep,
        obj.isNotNull().alias("parsed"),
        coerce(get_s("intent"), P.INTENTS, d["intent"]).alias("intent"),
        coerce(get_s("escalation"), P.ESCALATIONS, d["escalation"]).alias("escalation"),
        coerce(get_s("reason"), P.REASONS, d["reason"]).alias("reason"),
        F.coalesce(F.try_variant_get(obj, "$.confidence", "double"),
                   F.lit(d["confidence"])).alias("confidence"),
        obj.alias("_obj"))
