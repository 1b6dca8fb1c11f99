"""Globs as anchored regular expressions that Java, Python and RE2 read alike."""

from __future__ import annotations

import re

_SPECIAL = set("\\.^$|+()[]{}")


def to_regex(glob: str) -> str | None:
    """None for an invalid glob. A star crosses folders; ``**/`` in front matches no folder too; ``/**`` at the end needs something below."""
    out, i, depth, n = [], 0, 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**", i):
            start, end = i == 0 or glob[i - 1] == "/", i + 2 == n or glob[i + 2] == "/"
            if start and end and i == 0 and i + 2 < n:
                out.append("(?:/?|.*/)")
                i += 3
            elif start and end and i + 2 == n and i:
                out[-1] = "/.*"
                i += 2
            elif start and end and i:
                out[-1] = "(?:/|/.*/)"
                i += 3
            else:
                out.append(".*")
                i += 2
        elif c == "*":
            out.append(".*")
            i += 1
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^")
            out.append(f"[{'^' * negated}{body}]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
            i += 1
        elif c == "}":
            if not depth:
                return None
            depth -= 1
            out.append(")")
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\" and i + 1 < n:
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append("\\" + c if c in _SPECIAL else c)
            i += 1
    return f"^{''.join(out)}$" if not depth else None


def any_of(globs) -> str | None:
    """One expression for several globs; invalid ones are left out, None if none is left."""
    found = [r for r in map(to_regex, globs) if r]
    return "|".join(f"(?:{r})" for r in found) or None
