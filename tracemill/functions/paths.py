"""Source paths: prefix rewriting, stripping and byte globs, as column expressions and as plain functions for readers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.numbers import bytes_view

_SEPARATORS = "/\\"


@dataclass(frozen=True)
class PathRules:
    """Rewriting rules in their order, then a prefix to strip, then globs on the rewritten path."""

    rebases: tuple[tuple[str, str], ...] = ()
    strip: str | None = None
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()

    def rewrite(self, path: str) -> str:
        for old, new in self.rebases:
            rest = _after_prefix(path, old)
            if rest is None:
                continue
            separator = _separator(new, path[len(old):len(old) + 1])
            tail = re.sub(r"[/\\]", lambda _: separator, rest)
            joint = separator if tail and new and new[-1] not in _SEPARATORS else ""
            path = new + joint + tail
        if self.strip is not None and (rest := _after_prefix(path, self.strip)) is not None:
            path = rest
        return path

    def selects(self, path: str) -> bool:
        if self.includes and not any(glob_matches(p, path) for p in self.includes):
            return False
        return not any(glob_matches(p, path) for p in self.excludes)


def _separator(new: str, following: str) -> str:
    if ("\\" in new) != ("/" in new):
        return "\\" if "\\" in new else "/"
    return "\\" if following == "\\" else "/"


def _after_prefix(path: str, prefix: str) -> str | None:
    """What follows ``prefix`` and the separators after it, if the prefix ends at a part's boundary; all of it for an empty prefix."""
    if not prefix:
        return path
    if not path.startswith(prefix):
        return None
    rest = path[len(prefix):]
    if rest and rest[0] not in _SEPARATORS and prefix[-1] not in _SEPARATORS:
        return None
    return rest.lstrip(_SEPARATORS)


def _glob_tokens(pattern: str) -> list[tuple[str, str]]:
    """(literal, regex) per element over the byte view; the literal is what the element may also match by being equal to it."""
    view = pattern.encode("utf-8").decode("latin-1")
    tokens, i = [], 0
    while i < len(view):
        c = view[i]
        if c == "[" and (end := view.find("]", i + 1)) >= 0:
            tokens.append(("[", _class_regex(view[i + 1:end]), view[i + 1:end + 1]))
            i = end + 1
            continue
        tokens.append((c, "." if c == "?" else ".*" if c == "*" else re.escape(c), ""))
        i += 1
    return tokens


def _class_regex(body: str) -> str:
    inverted = body[:1] in ("!", "^") and body != ""
    body = body[1:] if inverted else body
    spans, k = [], 0
    while k < len(body):
        if k + 2 < len(body) and body[k + 1] == "-":
            if body[k] <= body[k + 2]:
                spans.append(f"\\x{ord(body[k]):02x}-\\x{ord(body[k + 2]):02x}")
            k += 3
        else:
            spans.append(f"\\x{ord(body[k]):02x}")
            k += 1
    if not spans:
        return "." if inverted else "(?!)"
    return f"[{'^' if inverted else ''}{''.join(spans)}]"


def glob_regex(pattern: str) -> str:
    """The glob as a regular expression over ``bytes_view``: ``*`` crosses separators, ``?`` is one byte, ``[`` without ``]`` is itself.

    Right for texts that hold neither ``*`` nor ``[``; for those see ``glob_matches``.
    """
    return "(?s)^" + "".join(regex for _, regex, _ in _glob_tokens(pattern)) + r"\z"


def glob_matches(pattern: str, text: str) -> bool:
    """The glob for any text. A ``*`` or ``[`` of the pattern that faces the same character in the text stands for that
    character alone: equality is tried before the wildcard meaning, without coming back to it."""
    if "*" not in text and "[" not in text:
        return re.match(glob_regex(pattern).replace(r"\z", r"\Z"), text.encode("utf-8").decode("latin-1")) is not None
    p, t = pattern.encode("utf-8"), text.encode("utf-8")
    # positions to come back to, the last star only: later stars make earlier ones pointless
    at, pos, resume = 0, 0, None
    while pos < len(t):
        step = _glob_step(p, at, t[pos])
        if step == "star":
            resume = (at + 1, pos)
            at += 1
        elif step:
            at, pos = step, pos + 1
        elif resume:
            at, pos = resume[0], resume[1] + 1
            resume = (resume[0], pos)
        else:
            return False
    return not p[at:].strip(b"*")


def _glob_step(p: bytes, at: int, byte: int) -> int | str | None:
    """The pattern position after matching one byte, ``star``, or None if it can't match."""
    if at >= len(p):
        return None
    if p[at] in (byte, 0x3F):
        return at + 1
    if p[at] == 0x5B and (end := p.find(b"]", at + 1)) >= 0:
        if re.match(_class_regex(p[at + 1:end].decode("latin-1")), chr(byte), re.S):
            return end + 1
    return "star" if p[at] == 0x2A else None


def _strip_pattern(prefix: str) -> str:
    boundary = "" if prefix[-1] in _SEPARATORS else r"(?=[/\\]|\z)"
    return rf"^\Q{prefix}\E{boundary}[/\\]*"


def rebased(path: Column, old: str, new: str) -> Column:
    """One rewriting rule on a column: the boundary-checked prefix is replaced, the tail takes the separators of ``new``."""
    fixed = ("\\" in new) != ("/" in new)
    if old:
        matches = path.rlike(_strip_pattern(old))
        rest = F.regexp_replace(path, _strip_pattern(old), "")
    else:
        matches, rest = path.isNotNull(), path

    def joined(separator: str) -> Column:
        tail = F.translate(rest, _SEPARATORS, separator * 2)
        joint = separator if new and new[-1] not in _SEPARATORS else ""
        return F.when(tail != "", F.concat(F.lit(new + joint), tail)).otherwise(new)

    if fixed:
        result = joined("\\" if "\\" in new else "/")
    else:
        result = F.when(F.substring(path, len(old) + 1, 1) == "\\", joined("\\")).otherwise(joined("/"))
    return F.when(matches, result).otherwise(path)


def stripped(path: Column, prefix: str) -> Column:
    return F.regexp_replace(path, _strip_pattern(prefix), "") if prefix else path


def normalized(path: Column) -> Column:
    """A path with ``/`` only, without empty and ``.`` parts, and with each ``..`` taken back as far as possible; an empty path is ``.``."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    # two slashes in front are kept, three and more are one
    root = F.when(plain.rlike("^//(?!/)"), "//").when(plain.startswith("/"), "/").otherwise("")

    def step(kept: Column, part: Column) -> Column:
        up = part == ".."
        removable = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return F.when(up & removable, F.slice(kept, 1, F.size(kept) - 1)).when(up & (root != ""), kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.filter(F.split(plain, "/"), lambda x: (x != "") & (x != "."))
    joined = F.concat(root, F.array_join(F.reduce(parts, F.slice(parts, 1, 0), step), "/"))
    return F.when(joined == "", ".").otherwise(joined)


def selected(path: Column, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> Column:
    """Any include (or none given) and no exclude; right for paths without ``*`` and ``[``."""
    view, keep = bytes_view(path), F.lit(True)
    if includes:
        keep = F.lit(False)
        for pattern in includes:
            keep = keep | view.rlike(glob_regex(pattern))
    for pattern in excludes:
        keep = keep & ~view.rlike(glob_regex(pattern))
    return keep


def apply_rules(df: DataFrame, column: str, rules: PathRules) -> DataFrame:
    """Rewrite and filter a path column of any table; null paths go if there is an include and stay otherwise."""
    path = F.col(column)
    for old, new in rules.rebases:
        path = rebased(path, old, new)
    if rules.strip is not None:
        path = stripped(path, rules.strip)
    df = df.withColumn(column, path)
    if not rules.includes and not rules.excludes:
        return df
    odd = F.col(column).contains("*") | F.col(column).contains("[")
    keep = F.coalesce(selected(F.col(column), rules.includes, rules.excludes), F.lit(not rules.includes))

    @F.pandas_udf("boolean")
    def exact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else rules.selects(t))

    # the rare texts with glob characters of their own take the exact matcher; it sees nulls for all others
    return df.filter(F.when(F.coalesce(odd, F.lit(False)), exact(F.when(odd, F.col(column)))).otherwise(keep))
