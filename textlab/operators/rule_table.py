"""Decisions from a rules table: data instead of expressions.

A rules table has one row per rule:

``decision``     what it decides (several decisions may share one table)
``priority``     the smallest that applies wins, then the smallest tag
``tag``          the outcome
``pattern``      alternatives ``a|b|c``, matched as whole words in any case; null: no test
``intents``      the intents it holds for; null: all
``not_intents``  intents it does not hold for; null: none
``escalation``   the escalation it needs; null: any
``above``        the message's amount must be larger; null: no test

All patterns of a table are compiled into one matcher: alternatives that are
plain words or phrases into one Aho-Corasick automaton, which reads a text once
whatever their number, the others one regular expression each.  A text gets the
numbers of the patterns it holds; a decision is then one filter over the table,
which every row sees as one constant.  Adding a rule adds a row and changes no
plan.

Cases: null text holds no pattern; a null intent meets no ``intents`` and no
``not_intents``; without a rule that applies the outcome is null; an empty table
decides nothing; a table of more than ``MOST_RULES`` rows is an error, as it is
part of every task.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from .rules import message_amount

MOST_RULES = 10_000
SCHEMA = ("decision string, priority int, tag string, pattern string, intents array<string>, not_intents array<string>, "
          "escalation string, above long")
_PLAIN = re.compile(r"[\w' ]+\Z")


def alternatives(pattern: str) -> list[str]:
    """The pattern's parts between the ``|`` that stand outside brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(pattern):
        if c == "\\" and pattern[k:k + 2] in ("\\|", "\\(", "\\)", "\\[", "\\]"):
            raise ValueError(f"escaped brackets and bars are not read: {pattern!r}")
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append(pattern[at:k])
            at = k + 1
    return [*out, pattern[at:]]


class Matcher:
    """Which of several patterns a lower-case text holds as whole words."""

    def __init__(self, patterns: list[str]):
        import ahocorasick
        import regex

        words: dict[str, set[int]] = {}
        self.others = []
        for n, pattern in enumerate(patterns):
            for part in alternatives(pattern):
                if _PLAIN.match(part):
                    words.setdefault(part.lower(), set()).add(n)
                else:
                    self.others.append((n, regex.compile(P.words(part)).search))
        self.automaton = ahocorasick.Automaton()
        for word, numbers in words.items():
            self.automaton.add_word(word, (len(word), numbers))
        self.empty = not words
        if words:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[int]:
        found: set[int] = set()
        if not self.empty:
            for last, (size, numbers) in self.automaton.iter(text):
                a, b = last - size, last + 1
                if numbers <= found:
                    continue
                if (a < 0 or not _word_character(text[a])) and (b == len(text) or not _word_character(text[b])):
                    found |= numbers
        found |= {n for n, search in self.others if n not in found and search(text)}
        return sorted(found)


def _word_character(c: str) -> bool:
    return c == "_" or c.isalnum()


def with_hits(df: DataFrame, text: str, patterns: list[str], hits: str = "hits") -> DataFrame:
    """Adds ``hits``, the numbers of the patterns in ``text``."""
    low = df.withColumn("_low", F.lower(F.col(text)))
    fields = [f for f in low.schema.fields if f.name != "_low"]
    schema = T.StructType([*fields, T.StructField(hits, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        match = Matcher(patterns)
        for batch in batches:
            found = pa.array([match(t) if t else [] for t in batch.column(len(fields)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(fields))), found], names=schema.names)

    return low.mapInArrow(run, schema)


def _test(decision: str, intent: str, escalation: Column):
    """Whether a rule is of the decision and all its conditions hold."""
    def applies(r: Column) -> Column:
        conditions = [r["number"].isNull() | F.array_contains(F.col("_hits"), r["number"]),
                      r["intents"].isNull() | F.array_contains(r["intents"], F.col(intent)),
                      r["not_intents"].isNull() | ~F.array_contains(r["not_intents"], F.col(intent)),
                      r["escalation"].isNull() | (r["escalation"] == escalation),
                      r["above"].isNull() | (F.col("_amount") > r["above"])]
        every = r["decision"] == decision
        for condition in conditions:
            every = every & F.coalesce(condition, F.lit(False))
        return every

    return applies


def decide(df: DataFrame, rules: DataFrame, decisions: list[str], text: str, intent: str, amounts: bool = True) -> DataFrame:
    """``df`` plus one column per decision, in order; a decision named
    ``escalation`` is seen by those after it."""
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names = df.columns
    patterns = sorted({r["pattern"] for r in rows if r["pattern"] is not None})
    number = {p: n for n, p in enumerate(patterns)}
    fields = SCHEMA + ", number int"
    table = json.dumps([{**r.asDict(), "number": number.get(r["pattern"])} for r in rows])
    out = with_hits(df, text, patterns, "_hits").withColumn("_rules", F.from_json(
        F.lit(table), f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>>"))
    out = out.withColumn("_amount", message_amount(text) if amounts else F.lit(None).cast("long"))
    for decision in decisions:
        escalation = F.col("escalation") if "escalation" in out.columns else F.lit(None).cast("string")
        applies = _test(decision, intent, escalation)
        first = F.array_min(F.transform(F.filter("_rules", applies), lambda r: F.struct(r["priority"].alias("p"), r["tag"].alias("t"))))
        out = out.withColumn(decision, first["t"])
    return out.select(*names, *decisions)


def policy_table(always=P.ALWAYS_ESCALATE, critical=P.CRITICAL_WORDS, repeat=P.REPEAT_WORDS, repeat_intents=P.REPEAT_INTENTS,
                 reasons=P.REASON_RULES, by_intent=P.REASON_BY_INTENT, amounts: dict | None = None) -> list[tuple]:
    """The escalation policy, its reasons in code order (``reason_hybrid``,
    ``reason_simple``) and in documented order (``reason_policy``) as rows."""
    def row(decision, priority, tag, pattern=None, intents=None, not_intents=None, escalation=None, above=None):
        return (decision, priority, tag, pattern, intents, not_intents, escalation, above)

    low = list(P.HYBRID_LOW_RISK_INTENTS)
    out = [row("escalation", 0, "escalate", intents=list(always)), row("escalation", 1, "escalate", critical),
           row("escalation", 2, "escalate", repeat, list(repeat_intents)), row("escalation", 3, "auto_handle")]
    for decision in ("reason_hybrid", "reason_simple"):
        out += [row(decision, k, tag, words) for k, (tag, words) in enumerate(reasons)]
        out += [row(decision, 100 + k, tag, intents=[name]) for k, (name, tag) in enumerate(by_intent)]
    out += [row("reason_hybrid", 200, "low_risk", intents=low), row("reason_hybrid", 201, "deterministic_action"),
            row("reason_simple", 200, "low_risk")]
    rank = {tag: k for k, tag in enumerate(P.POLICY_PRIORITY)}
    out += [row("reason_policy", rank[tag], tag, words) for tag, words in reasons]
    out += [row("reason_policy", rank[tag], tag, intents=[name]) for name, tag in by_intent]
    out += [row("reason_policy", rank["high_value"], "high_value", intents=[name], above=limit) for name, limit in (amounts or {}).items()]
    out += [row("reason_policy", rank["deterministic_action"], "deterministic_action", not_intents=low, escalation="auto_handle"),
            row("reason_policy", rank["low_risk"], "low_risk")]
    return out
