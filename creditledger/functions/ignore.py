"""Ignore rules: a short ordered list folded into one predicate."""

from __future__ import annotations

import re
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditledger.functions.fixed_values import WHITE_SPACE
from creditledger.functions.paths import base_name

_LITERAL = set(".[](){}^$+|")


class IgnoreRule(NamedTuple):
    regex: str
    negate: bool = False
    dir_only: bool = False


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex of an ignore glob.

    `*` stays inside one path element, and so does `**`, which takes one
    character of any kind first; `?` is any character; the rest is literal.
    """

    def piece(match: re.Match) -> str:
        token = match.group()
        if token == "**":
            return ".[^/]*"
        if token == "*":
            return "[^/]*"
        if token == "?":
            return "."
        return "\\" + token if token in _LITERAL else token

    return "^" + re.sub(r"\*\*|.", piece, glob) + r"\z"


def parse_ignore_rules(text: str) -> list[IgnoreRule]:
    rules = []
    for line in text.split("\n"):
        line = line.strip(WHITE_SPACE)
        if not line or line.startswith("#"):
            continue
        negate = line.startswith("!")
        glob = line[1:] if negate else line
        dir_only = glob.endswith("/")
        regex = glob_to_regex(glob[:-1] if dir_only else glob)
        try:
            re.compile(regex[:-2])
        except re.error:
            continue
        rules.append(IgnoreRule(regex, negate, dir_only))
    return rules


def is_ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """Last matching rule wins; directory rules never match a file.

    Neighbouring rules of the same sign cannot override each other, so each
    such run is one alternation: the expression grows with the number of sign
    changes, not with the number of rules.
    """
    applicable = [rule for rule in rules if not rule.dir_only]
    base = base_name(path)
    verdicts = []
    for negate, run in groupby(applicable, key=lambda rule: rule.negate):
        regex = "(?d)" + "|".join(f"(?:{rule.regex})" for rule in run)
        matched = path.rlike(regex) | base.rlike(regex)
        verdicts.append(F.when(matched, F.lit(not negate)))
    return F.coalesce(*reversed(verdicts), F.lit(False))
