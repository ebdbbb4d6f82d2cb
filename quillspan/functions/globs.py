"""Glob patterns as regular expressions.

`*` and `?` stay within a path segment, `**` crosses segments (`**/x` also
matches `x`), `[abc]`, `[!abc]`, `{a,b}`, and a backslash escapes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str, dotfiles: bool = True) -> str:
    """An anchored regular expression; without dotfiles, wildcards do not match a leading dot of a segment."""
    out, i, depth = [], 0, 0
    guard = "" if dotfiles else r"(?!\.)"
    while i < len(pattern):
        c = pattern[i]
        leads = i == 0 or pattern[i - 1] == "/"
        if pattern.startswith("**", i):
            j = i + 2
            if leads and pattern[j : j + 1] == "/":
                out.append(f"(?:{guard}[^/]*/)*" if not dotfiles else "(?:.*/)?")
                i = j + 1
                continue
            out.append(".*" if dotfiles else r"(?:(?!\.)[^/]*(?:/(?!\.)[^/]*)*)")
            i = j
            continue
        if c == "*":
            out.append((guard if leads else "") + "[^/]*")
        elif c == "?":
            out.append((guard if leads else "") + "[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            negated = inner[0] in "!^"
            body = (inner[1:] if negated else inner).replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out.append(f"[^/{body}]" if negated else f"[{body}]")
            i = end
        elif c == "{" and "}" in pattern[i:]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def literal_prefix(pattern: str) -> str:
    """What every matching path begins with: the pattern up to its first special character."""
    return re.match(r"[^*?\[{},\\]*", pattern)[0]


def matches(path: Column, patterns: list[str], dotfiles: bool = True) -> Column:
    """Whether any pattern matches; false for no patterns."""
    return path.rlike("|".join(f"(?:{glob_regex(p, dotfiles)})" for p in patterns)) if patterns else F.lit(False)


def exclude_pattern(pattern: str) -> str:
    """A bare name is excluded at any depth."""
    return pattern if "/" in pattern or "\\" in pattern else f"**/{pattern}"


def chosen_path(path: Column, include: list[str], exclude: list[str], dotfiles: bool = False) -> Column:
    """Whether an include pattern matches and no exclude pattern does."""
    return matches(path, include, dotfiles) & ~matches(path, [exclude_pattern(p) for p in exclude], True)


def glob_filter(df: DataFrame, path_col: str, include: list[str], exclude: list[str], dotfiles: bool = False) -> DataFrame:
    """Rows whose path matches an include pattern and no exclude pattern. Without include patterns there are none."""
    return df.where(chosen_path(F.col(path_col), include, exclude, dotfiles))
