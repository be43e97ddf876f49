"""Whole-string regex rules: a pattern found anywhere turns the entire value into the replacement.

A rule's pattern is of the kind without look-around and back-references.  For Spark it becomes a Java pattern: named
groups lose their names, ``(?dU)`` gives line ends and classes the same meaning.  Rules whose replacement can't be mistaken
are expressions in the plan; the others (:meth:`Rule.plain` is false) run in an Arrow UDF, over distinct subjects.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

FIELDS = ("track", "album", "artist", "album_artist")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_TOKEN = re.compile(r"\\[\\${}]|\$\$|\$\{[^{}]*\}|\$\d|[^\\$]+|.", re.S)


@dataclass(frozen=True)
class Rule:
    """Find, replace, flags: i ignore case, c regard it (the last of both counts), e single line, s dot meets line ends, m keep lines."""

    find: str
    replace: str
    flags: str = ""

    def modes(self) -> tuple[bool, bool, bool]:
        """(ignore case, multiline, dot meets line ends)"""
        cases = [f for f in self.flags if f in "ic"]
        lines = "e" not in self.flags and not ("s" in self.flags and "m" not in self.flags)
        return bool(cases) and cases[-1] == "i", lines, "s" in self.flags

    def compiled(self) -> re.Pattern:
        case, lines, dot = self.modes()
        if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", self.find):
            raise ValueError("look-around and back-references aren't part of this dialect")
        return re.compile(_NAMED.sub(r"(?P<\1>", self.find), re.I * case | re.M * lines | re.S * dot)

    def java(self) -> str:
        case, lines, dot = self.modes()
        self.compiled()
        return f"(?dU{'i' * case}{'m' * lines}{'s' * dot})" + _NAMED.sub("(", self.find)

    def pieces(self) -> list[str | int]:
        """The replacement as literals and numbers of groups, read from left to right."""
        pattern, out = self.compiled(), []
        for token in _TOKEN.findall(self.replace):
            if token in (r"\\", r"\$", r"\{", r"\}"):
                out.append(token[1])
            elif token == "$$":
                out.append("$")
            elif re.fullmatch(r"\$\d", token) and int(token[1]) <= pattern.groups:
                out.append(int(token[1]))
            elif token.startswith("${") and token[2:-1] in pattern.groupindex:
                out.append(pattern.groupindex[token[2:-1]])
            else:
                out.append(token)
        return out

    def plain(self) -> bool:
        """Whether reading the replacement from left to right is exact: every group takes part in each match, and no inserted text can be read again."""
        used = [p for p in self.pieces() if isinstance(p, int)]
        if not used:
            return True
        optional = "|" in self.find or re.search(r"\)(?:[?*]|\{0)", self.find)
        return not optional and set(used) == {self.compiled().groups} and not self.compiled().groupindex

    def expand(self, match: re.Match) -> str:
        """The replacement for a match: numbers in ascending order, then names, each wherever it stands by then; groups without a match stay as written."""
        hidden = {"\\\\": "b", r"\$": "d", "$$": "d", r"\{": "l", r"\}": "r"}
        text = reduce(lambda t, kv: t.replace(*kv), hidden.items(), self.replace)
        found = [(f"${n}", match.group(n)) for n in range(match.re.groups + 1)]
        found += [("${" + name + "}", match.group(name)) for name in match.re.groupindex]
        text = reduce(lambda t, kv: t if kv[1] is None else t.replace(*kv), found, text)
        shown = {"d": "$", "l": "{", "r": "}", "b": "\\"}
        return reduce(lambda t, kv: t.replace(*kv), shown.items(), text)

    def matches(self, value: Column) -> Column:
        return value.rlike(self.java())

    def apply(self, value: Column) -> Column:
        """The rewritten value; null stays null."""
        if self.plain():
            parts = [F.regexp_extract(value, self.java(), p) if isinstance(p, int) else F.lit(p) for p in self.pieces()]
            return F.when(self.matches(value), F.concat(*parts) if parts else F.lit("")).otherwise(value)
        rule = self

        @F.pandas_udf("string")
        def rewritten(values: pd.Series) -> pd.Series:
            pattern = rule.compiled()
            return values.map(lambda v: v if v is None or not (m := pattern.search(v)) else rule.expand(m))

        return rewritten(value)


@dataclass(frozen=True)
class RewriteRule:
    """Rules for the fields of an edit, all of which must match."""

    fields: dict[str, Rule] = field(default_factory=dict)
    name: str | None = None
    requires_confirmation: bool = False
    requires_catalogue: bool = False

    def matches_track(self) -> Column:
        """On plays: a missing field is the empty text; no fields match everything."""
        return reduce(Column.__and__, [r.matches(F.coalesce(F.col(f), F.lit(""))) for f, r in self.fields.items()], F.lit(True))

    def matches_edit(self) -> Column:
        """On edits: a missing value is matched by the pattern ``.*`` alone."""
        each = [F.coalesce(r.matches(F.col(f)), F.lit(r.find == ".*")) for f, r in self.fields.items()]
        return reduce(Column.__and__, each, F.lit(True))


def rules_from_rows(rows) -> list[RewriteRule]:
    """Rules from dictionaries: {field}_name: {find, replace, flags?}, name?, requires_confirmation?, requires_catalogue?"""
    return [RewriteRule({f: Rule(r[f"{f}_name"]["find"], r[f"{f}_name"]["replace"], r[f"{f}_name"].get("flags") or "") for f in FIELDS if r.get(f"{f}_name")}, r.get("name"), bool(r.get("requires_confirmation")), bool(r.get("requires_catalogue"))) for r in rows]


def rules_hash(rows) -> str:
    """SHA-256 of the rules as canonical JSON: another hash means that everything must be looked at again."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def apply_chain(subjects: DataFrame, rules: list[RewriteRule], catalogue_ok: dict[str, bool] | None = None) -> DataFrame:
    """Rules one after another, each on what the one before made: adds ``new_<field>``, ``confirm``, ``changed``.

    One stage of the plan for each rule, its match worked out once, so the plan grows with the number of rules and not
    beyond.  A rule that wants the catalogue's consent is skipped where that is refused; where it isn't known
    (``catalogue_ok`` is None) the rule applies, to be confirmed.
    """
    out = subjects.withColumns({**{f"new_{f}": F.col(f) for f in FIELDS}, "confirm": F.lit(False)})
    for rule in rules:
        if rule.requires_catalogue and catalogue_ok is not None and not catalogue_ok.get(rule.name, False):
            continue
        on_edit = RewriteRule({f"new_{f}": r for f, r in rule.fields.items()})
        out = out.withColumn("__hit", on_edit.matches_edit())
        changed = {f"__{f}": F.when(F.col("__hit"), r.apply(F.col(f"new_{f}"))).otherwise(F.col(f"new_{f}")) for f, r in rule.fields.items()}
        out = out.withColumns(changed)
        differs = reduce(Column.__or__, [~F.col(f"__{f}").eqNullSafe(F.col(f"new_{f}")) for f in rule.fields], F.lit(False))
        ask = rule.requires_confirmation or (rule.requires_catalogue and catalogue_ok is None)
        out = out.withColumns({"confirm": F.col("confirm") | (differs & F.lit(ask)), **{f"new_{f}": F.col(f"__{f}") for f in rule.fields}}).drop("__hit", *changed)
    return out.withColumn("changed", reduce(Column.__or__, [~F.col(f).eqNullSafe(F.col(f"new_{f}")) for f in FIELDS]))


def _ending() -> str:
    """A note about an edition at a title's end: behind a dash or in brackets a year, or words for a new master or mix with or without one; or such a master by itself."""
    year = r"(?:19|20)\d\d"
    note = rf"(?:{year}\s+)?(?:digital(?:ly)?\s+)?(?:remaster(?:ed)?|mix)\b[^()\[\]]*"
    said = f"(?:{note}|{year})"
    return rf"(?:\s*[-\u2013\u2014]\s*{said}|\s*\(\s*{said}\s*\)|\s*\[\s*{said}\s*\]|\s+remaster(?:ed)?(?:\s+{year})?)"


def without_suffixes(title: Column) -> Column:
    """The title without notes about its edition at the end, however many; a title that would be empty stays."""
    out = F.trim(F.regexp_replace(title, rf"(?i){_ending()}+\s*$", ""))
    return F.when(out == "", title).otherwise(out)


def without_pattern(plays: DataFrame, pattern: str, artist: str | None = None) -> DataFrame:
    """Clean-up of one artist's catalogue: plays' different tracks (artist, track) that a pattern is found in → new_track, all matches cut out and trimmed; none that would be empty."""
    rows = plays if artist is None else plays.filter(F.col("artist") == artist)
    java = Rule(pattern, "").java()
    cut = F.trim(F.regexp_replace("track", java, ""))
    return rows.select("artist", "track").distinct().filter(F.col("track").rlike(java)).withColumn("new_track", cut).filter((F.col("new_track") != "") & (F.col("new_track") != F.col("track")))


def any_rule(rules: list[RewriteRule]) -> Column:
    """Whether some rule matches an edit as it is: without one, the chain has nothing to do."""
    return reduce(Column.__or__, [r.matches_edit() for r in rules], F.lit(False))


def default_rules(rows) -> list[RewriteRule]:
    """Rules of a shipped list: their patterns ignore case, besides what their own flags say."""
    def folded(row):
        return {k: ({**v, "flags": "i" + (v.get("flags") or "")} if k.endswith("_name") and v else v) for k, v in row.items()}

    return rules_from_rows([folded(r) for r in rows])
