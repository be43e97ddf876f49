"""Rewrite rules as a table: one fold over an array of rules, so that the plan doesn't grow with their number.

Each rule is a struct of patterns and replacements in parts, and the chain is an ``aggregate`` whose state is the subject as rewritten so far.  Before a pattern runs, a
piece of text that any match must hold is looked for, which most rules of a long list fail.  Rules whose replacement can't be read from left to right
(:meth:`playlake.functions.rules.Rule.plain`) run between two folds, as in the chain of stages; results are those of :func:`playlake.functions.rules.apply_chain`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F

from playlake.functions.rules import FIELDS, RewriteRule, Rule, apply_chain

_FIELD = "struct<java:string,any:boolean,fold:boolean,held:string,parts:array<struct<n:int,t:string>>>"
_TABLE = f"array<struct<{','.join(f'{f}:{_FIELD}' for f in FIELDS)},ask:boolean>>"
_SIGNS = "^$.|?*+()[]{}\\"


def required(rule: Rule) -> str | None:
    """The longest piece of text that every match of the rule's pattern holds; none if that can't be told at a glance.

    Only what stands outside of brackets counts.  Where case is ignored, only signs whose two cases are the plain ones count, and the piece is in lower case.
    """
    fold, pattern = rule.modes()[0], rule.find
    if re.search(r"\(\?(?!:|P?<)|\\[xupPkc0NQ]", pattern):  # flags within, or escapes that take more than a sign
        return None
    runs, run, depth, k = [], "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        token = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{\d*,?\d*\}|.", re.S).match(pattern, k)[0]
        k += len(token)
        if c == "|" and depth == 0:
            return None
        literal = ""
        if len(token) == 1 and c not in _SIGNS:
            literal = token
        elif c == "\\" and not token[1:].isalnum():
            literal = token[1:]
        if fold and literal and (not literal.isascii() or literal.lower() in "ski"):
            literal = ""
        depth += {"(": 1, ")": -1}.get(token, 0)
        if token in ("?", "*") or (c == "{" and len(token) > 1):
            run = run[:-1]
        if literal and depth == 0:
            run += literal
        else:
            runs.append(run)
            run = ""
    best = max([*runs, run], key=len)
    return (best.lower() if fold else best) or None


def _row(rule: RewriteRule, ask: bool) -> dict:
    def field(r: Rule) -> dict:
        parts = [{"n": p, "t": None} if isinstance(p, int) else {"n": None, "t": p} for p in r.pieces()]
        return {"java": r.java(), "any": r.find == ".*", "fold": r.modes()[0], "held": required(r), "parts": parts}

    return {f: field(rule.fields[f]) if f in rule.fields else None for f in FIELDS} | {"ask": ask}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(table: Column, state: Column) -> Column:
    def matched(rule: Column, value: Column) -> Column:
        text = F.when(rule["fold"], F.lower(value)).otherwise(value)
        may = rule["held"].isNull() | F.contains(text, rule["held"])
        return F.when(may, F.rlike(value, rule["java"])).when(value.isNotNull(), F.lit(False))

    def rewritten(rule: Column, value: Column) -> Column:
        parts = F.transform(rule["parts"], lambda p: F.when(p["n"].isNull(), p["t"]).otherwise(F.call_function("regexp_extract", value, rule["java"], p["n"])))
        # A missing value is met by the pattern of everything only, and stays missing.
        return F.when(rule.isNull() | value.isNull(), value).otherwise(F.array_join(parts, ""))

    def step(now: Column, rule: Column) -> Column:
        hit = reduce(Column.__and__, [rule[f].isNull() | F.coalesce(matched(rule[f], now[f]), rule[f]["any"]) for f in FIELDS])

        def made(new: Column) -> Column:
            differs = reduce(Column.__or__, [~new[f].eqNullSafe(now[f]) for f in FIELDS])
            return F.struct(*(new[f].alias(f) for f in FIELDS), (now["confirm"] | (differs & rule["ask"])).alias("confirm"))

        return F.when(hit, _let(F.struct(*(rewritten(rule[f], now[f]).alias(f) for f in FIELDS)), made)).otherwise(now)

    return F.aggregate(table, state, step)


def apply_table(subjects: DataFrame, rules: Sequence[RewriteRule], catalogue_ok: dict[str, bool] | None = None) -> DataFrame:
    """Rules one after another, as :func:`playlake.functions.rules.apply_chain`: adds ``new_<field>``, ``confirm``, ``changed``."""
    kept = [r for r in rules if not (r.requires_catalogue and catalogue_ok is not None and not catalogue_ok.get(r.name, False))]
    out = subjects.withColumns({**{f"new_{f}": F.col(f) for f in FIELDS}, "confirm": F.lit(False)})
    for plain, run in groupby(kept, lambda r: all(f.plain() for f in r.fields.values())):
        part = list(run)
        if plain:
            told = json.dumps([_row(r, r.requires_confirmation or (r.requires_catalogue and catalogue_ok is None)) for r in part])
            state = F.struct(*(F.col(f"new_{f}").alias(f) for f in FIELDS), F.col("confirm").alias("confirm"))
            out = out.withColumn("__now", _fold(F.from_json(F.lit(told), _TABLE), state))
            out = out.withColumns({**{f"new_{f}": F.col(f"__now.{f}") for f in FIELDS}, "confirm": F.col("__now.confirm")}).drop("__now")
        else:
            names = {f: f"__old_{f}" for f in FIELDS}
            out = out.withColumnsRenamed(names).withColumnsRenamed({f"new_{f}": f for f in FIELDS} | {"confirm": "__confirm"})
            out = apply_chain(out, part, catalogue_ok).drop("changed", *FIELDS).withColumnsRenamed({old: f for f, old in names.items()})
            out = out.withColumn("confirm", F.col("confirm") | F.col("__confirm")).drop("__confirm")
    return out.withColumn("changed", reduce(Column.__or__, [~F.col(f).eqNullSafe(F.col(f"new_{f}")) for f in FIELDS]))
