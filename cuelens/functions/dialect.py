"""One pattern source, two regex dialects: Java for Spark, RE2 for an SQL oracle.

Patterns are written as in scripts where ``\\b`` is a border of ASCII words and ``\\s`` is any Unicode
space. Java and RE2 mean less by them, so both are written out; what RE2 cannot say is refused.
"""

from __future__ import annotations

import re

_WORD = "A-Za-z0-9_"
_SPACES = r"\s\x{00a0}\x{3000}\x{feff}"


def _spaced(pattern: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACES if inside else f"[{_SPACES}]")
            i += 2
            continue
        if two[:1] == "\\":
            out.append(two)
            i += 2
            continue
        inside = (inside or two[0] == "[") and not (inside and two[0] == "]")
        out.append(two[0])
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    """For ``rlike`` and the ``regexp_*`` functions of Spark."""
    edge = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
    return _spaced(pattern).replace(r"\b", edge)


def re2(pattern: str) -> str:
    """For DuckDB; ``ValueError`` for lookaround and back references."""
    if re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)\\[1-9]", pattern):
        raise ValueError(f"RE2 has no form of {pattern!r}")
    return _spaced(pattern)


_PLAIN = {"n": "\n", "t": "\t", "r": "\r"}


def branches(pattern: str) -> list[tuple[str, str, bool]]:
    """(branch, text that each of its matches holds, whether the branch is that text alone) of a pattern's alternatives.

    The text is empty where none is sure. Only characters outside groups and classes count, and none that a
    quantifier follows.
    """
    if "(?" in pattern and re.search(r"\(\?[a-zA-Z-]", pattern):
        return [(pattern, "", False)]
    tokens = re.findall(r"\\[pPxu]\{[^}]*\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{\d+(?:,\d*)?\}|.", pattern, re.DOTALL)
    out, part, runs, run, depth, plain = [], "", [], "", 0, True

    def closed() -> tuple[str, str, bool]:
        return part, max([*runs, run], key=len), plain and not runs and run != ""

    for token in tokens:
        if token == "|" and depth == 0:
            out.append(closed())
            part, runs, run, plain = "", [], "", True
            continue
        part += token
        depth += (token == "(") - (token == ")")
        sure = token if len(token) == 1 and token not in "()[]{}|^$.*+?\\" else _PLAIN.get(token[1:], token[1:] if not token[1:].isalnum() else "") if token[0] == "\\" and len(token) == 2 else ""
        if depth == 0 and sure:
            run += sure
            continue
        if token in ("*", "?") or (token[0] == "{" and len(token) > 1):
            run = run[:-1]
        plain = False
        runs.append(run)
        run = ""
    return [*out, closed()]


def words(branch: str) -> list[str]:
    """The words of a branch that is a list of words between blanks or the text's ends, none of another; an optional last letter makes two."""
    listed = re.fullmatch(r"\(\^\| \)\(([a-z]+\??(?:\|[a-z]+\??)*)\)\( \|\$\)", branch)
    return [x for w in listed[1].split("|") for x in ([w[:-2], w[:-1]] if w.endswith("?") else [w]) if x] if listed else []


def needs_digit(branch: str) -> bool:
    """Whether each match of a branch surely holds a digit: one outside groups and classes that must occur."""
    if "(?" in branch:
        return False
    tokens = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", branch, re.DOTALL)
    depth, found = 0, False
    for token, after in zip(tokens, [*tokens[1:], ""], strict=True):
        depth += (token == "(") - (token == ")")
        if depth == 0 and token == "|":
            return False
        found = found or (depth == 0 and token == r"\d" and after not in ("*", "?") and not after.startswith(("{0", "{,")))
    return found


def literal(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
