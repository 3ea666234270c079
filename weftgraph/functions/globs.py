"""Path globs as Java regular expressions over bytes.

``*`` and ``?`` stay within a segment, ``**`` as a whole segment spans any
number of them, wildcards never match a leading dot, and ``$1`` to ``$9``
capture one or more bytes of a segment. A path is matched as Latin-1, so that a
character is a byte, with a slash appended.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = r"(?!)"


def bytewise(path: Column) -> Column:
    return F.concat(F.decode(path.cast("binary"), "ISO-8859-1"), F.lit("/"))


def _literal(text: str) -> str:
    return re.escape(text.encode().decode("latin-1"))


def _segment(segment: str, group) -> str:
    out = "" if segment.startswith(".") else r"(?!\.)"
    for token in re.findall(r"\*+|\?|\$[1-9]|[^*?$]+|\$", segment):
        if token[0] == "*":
            out += "[^/]*?"
        elif token == "?":
            out += "[^/]"
        elif re.fullmatch(r"\$[1-9]", token):
            out += group(int(token[1]))
        else:
            out += _literal(token)
    return out + "/"


def translate(pattern: str, group=lambda _: "([^/]+?)") -> str:
    """Regular expression, without anchors, of a glob; ``group`` gives that of a capture."""
    segments = pattern.split("/")
    if any(s in ("", ".", "..") for s in segments):
        return NEVER
    return "".join(r"(?:(?!\.)[^/]+/)*?" if s == "**" else _segment(s, group) for s in segments)


def matches(path: Column, pattern: str) -> Column:
    return bytewise(path).rlike(r"\A" + translate(pattern) + r"\z")


def matches_any(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | matches(path, p)
    return found


def outside_root(pattern: str) -> bool:
    """Whether some prefix of a glob has more ``..`` than other segments."""
    depth = 0
    for s in pattern.split("/"):
        depth += -1 if s == ".." else 0 if s in ("", ".") else 1
        if depth < 0:
            return True
    return False


def matches_pair(source: Column, target: Column, from_pattern: str, to_pattern: str) -> Column:
    """Both match, and the captures that ``from_pattern`` binds, leftmost and least first, hold in ``to_pattern``.

    The source's part is atomic: it is never matched otherwise to suit the target.
    """
    order: list[int] = []

    def bind(number: int) -> str:
        if number in order:
            return rf"\{order.index(number) + 1}"
        order.append(number)
        return "([^/]+?)"

    left = translate(from_pattern, bind)
    right = translate(to_pattern, lambda n: rf"\{order.index(n) + 1}" if n in order else "[^/]+?")
    both = F.concat(bytewise(source), F.lit("\0"), bytewise(target))
    return both.rlike(rf"\A(?>{left}\x00){right}\z")


def may_match_within(folder: Column, pattern: str) -> Column:
    """Whether some path below a folder could match: its segments match the first ones of the glob, and one is left."""
    segments = pattern.split("/")
    if any(s in ("", ".", "..") for s in segments):
        return F.lit(False)
    inner = ""
    for k, s in reversed(list(enumerate(segments))):
        if s == "**":
            inner = r"(?:(?!\.)[^/]+/)*" + (rf"(?:{inner})?" if inner else "")
        elif k < len(segments) - 1:
            inner = _segment(s, lambda _: "[^/]+?") + (rf"(?:{inner})?" if inner else "")
    return bytewise(folder).rlike(rf"\A(?:{inner})?\z") & (F.octet_length(folder) > 0)


def may_match_below_root(pattern: str) -> bool:
    """Whether a glob could match any path at all."""
    return translate(pattern) != NEVER
