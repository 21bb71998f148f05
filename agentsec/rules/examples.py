"""Texts that a rule finds, made from its pattern: so that scans of tables without any hit can be checked on rows that have one."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .compile import Rule

_CLASSES = {"CATEGORY_DIGIT": "7", "CATEGORY_WORD": "w", "CATEGORY_SPACE": " ", "CATEGORY_NOT_DIGIT": "x", "CATEGORY_NOT_WORD": "-", "CATEGORY_NOT_SPACE": "x"}


def _of_set(items) -> str:
    kinds = [(str(op), arg) for op, arg in items]
    if kinds[0][0] == "NEGATE":
        barred = {chr(a) for op, a in kinds if op == "LITERAL"} | {chr(c) for op, a in kinds if op == "RANGE" for c in range(a[0], min(a[1], 1000) + 1)}
        barred |= {c for op, a in kinds if op == "CATEGORY" for c in "x1 -" if re.match({"CATEGORY_SPACE": r"\s", "CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w"}.get(str(a), "$^"), c)}
        return next(c for c in "x1 -:@" if c not in barred)
    op, arg = kinds[0]
    return chr(arg) if op == "LITERAL" else chr(arg[0]) if op == "RANGE" else _CLASSES[str(arg)]


def _text(items, groups: dict[int, str]) -> str:
    """A shortest text for parsed items; what look-aheads ask for stands at the end."""
    out, later = "", ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name in ("ANY", "NOT_LITERAL"):
            out += "x" if name == "ANY" or arg != ord("x") else "y"
        elif name == "IN":
            out += _of_set(arg)
        elif name == "CATEGORY":
            out += _CLASSES[str(arg)]
        elif name == "BRANCH":
            out += _text(arg[1][0], groups)
        elif name == "SUBPATTERN":
            groups[arg[0]] = _text(arg[3], groups)
            out += groups[arg[0]]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            out += _text(arg[2], groups) * arg[0]
        elif name == "GROUPREF":
            out += groups.get(arg, "")
        elif name == "ASSERT" and arg[0] > 0:
            later += _text(arg[1], groups)
    return out + later


def example(rule: Rule) -> tuple[str, bool] | None:
    """(text, whether it must stand first) that the rule finds; None if none could be made."""
    from re import _parser

    flags = sum(getattr(re, f.upper()) for f in rule.flags if f in "ims")
    try:
        text = _text(_parser.parse(rule.pattern), {}).strip("\n")
        if re.search(rule.pattern, "x \n" + text, flags):
            return text, False
        if re.search(rule.pattern, text + "\nx", flags):
            return text, True
    except (re.error, KeyError, StopIteration):
        pass
    return None


def examples(rules: Iterable[Rule]) -> list[tuple[str, bool]]:
    return [e for e in map(example, rules) if e]
