"""Regular expressions: dialect, named groups, and one-pass capture."""

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.patterns import LINE_BREAK_RUNS, WHITE_SPACE_RUNS


def _class_body(runs: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in runs)


_SPACE = _class_body(WHITE_SPACE_RUNS)
# Blank and printable ASCII come first in the unions: they decide nearly every character of
# a log line, which makes the classes about twice as fast as the plain negation.
_OUTSIDE = {
    r"\s": f"[ {_SPACE}]",
    r"\S": f"[!-~[^{_SPACE}]]",
    ".": f"[ -~[^{_class_body(LINE_BREAK_RUNS)}]]",
    "$": r"\z",
}
# What Java does not know: any character, no character, and a brace that begins no count.
_ELSEWHERE = re.compile(r"\[\^\]|\[\]|\{(?!\d+(?:,\d*)?\})")
_AS_JAVA = {"[^]": "(?s:.)", "[]": "(?!)", "{": r"\{"}
_TOKEN = re.compile(r"\(\?<(?P<name>[A-Za-z_$][\w$]*)>|\\k<(?P<ref>[^>]+)>|\\.|\[\^?|\(\??|[\s\S]")


def _translate(pattern: str) -> tuple[str, dict[str, int]]:
    out, names, groups, in_class = [], {}, 0, False
    at = 0
    while at < len(pattern):
        if not in_class and (other := _ELSEWHERE.match(pattern, at)):
            out.append(_AS_JAVA[other.group()])
            at = other.end()
            continue
        token = _TOKEN.match(pattern, at)
        text = token.group()
        if in_class:
            # Within a class only these differ: white space, a bare "[", and "&&".
            if text.startswith(("[", "(")):
                text = text[0]
            at += len(text)
            if text == "]":
                in_class = False
            out.append({r"\s": _SPACE, "[": r"\[", "&": r"\&"}.get(text, text))
            continue
        at += len(text)
        if token["name"]:
            groups += 1
            names[token["name"]] = groups
            out.append("(")
        elif token["ref"]:
            if token["ref"] not in names:
                raise ValueError(f"the pattern refers to the group {token['ref']} before it")
            out.append(f"\\{names[token['ref']]}")
        elif text.startswith("["):
            in_class = True
            out.append(text)
        else:
            groups += text == "("
            out.append(_OUTSIDE.get(text, text))
    return "".join(out), names


def to_java(pattern: str) -> str:
    """Rewrite a pattern so that Java reads it as the ECMAScript user meant it."""
    return _translate(pattern)[0]


def named_groups(pattern: str) -> dict[str, int]:
    """Group name to capture index, counting unnamed groups too."""
    return _translate(pattern)[1]


def capture(line: Column, pattern: str, kind: str, groups: Sequence[int | None]) -> Column:
    """Match once and return ``['', kind, group, group, ...]``, or ``[line]`` without a match.

    One replacement yields all groups together, where an extraction per group would run the
    pattern once for each. The newline separator is safe: a line holds none by contract.
    Position 1 is NULL exactly if the line does not match; a group that took no part in the
    match, or is not asked for, is empty.
    """
    whole = f"^(?s:.*?)(?:{to_java(pattern)})(?s:.*)"
    fields = "".join("\n" if g is None else f"\n${g}" for g in groups)
    return F.split(F.regexp_replace(line, whole, f"\n{kind}{fields}"), "\n")
