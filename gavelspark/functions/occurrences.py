"""Where a pattern occurs in a text, as Column expressions: places, and what stands around them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

OCCURRENCE = "struct<start:int,end:int,term:string,value:string>"
#: Letters of all scripts, whatever their case; a line ends at \n alone.
ANY_CASE = "(?iUd)"


def _alternatives(pattern: str) -> list[str]:
    """A pattern's parts between its outermost bars."""
    out, depth, at = [""], 0, 0
    while at < len(pattern):
        step = 1
        if pattern[at] == "\\":
            step = 2
        elif pattern[at] == "[":
            step = pattern.index("]", at) - at + 1
        elif pattern[at] in "()":
            depth += 1 if pattern[at] == "(" else -1
        if pattern[at] == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += pattern[at : at + step]
        at += step
    return out


def _starts(pattern: str) -> list[str] | None:
    """Up to three letters or digits by which each match of a pattern begins; None if it may begin otherwise."""
    group = re.match(r"\(\?:", pattern)
    if group:
        end = next(i for i in range(1, len(pattern) + 1) if pattern[:i].count("(") == pattern[:i].count(")") and pattern[i - 1] == ")")
        if pattern[end : end + 1] in tuple("*{"):
            return None
        each = [_starts(p) for p in _alternatives(pattern[3 : end - 1])]
        each += [_starts(pattern[end + 1 :])] if pattern[end : end + 1] == "?" else []
        return None if None in each else sum(each, [])
    if pattern.startswith("([0-9]+"):
        return ["[0-9]"]
    plain = re.match(r"[a-z0-9]{0,3}(?![?*{])|[a-z0-9]{0,2}(?=[a-z0-9][?*{])", pattern)[0]
    return [plain] if plain else None


def quick(pattern: str) -> str:
    """The same pattern, whose alternatives look for their first letters before they look for the bound of a word: in all scripts that bound is dear, and it is asked for at each place of a text."""
    out = []
    for part in _alternatives(pattern):
        starts = _starts(part[2:]) if part.startswith("\\b") else None
        out.append(f"(?={'|'.join(dict.fromkeys(starts))}){part}" if starts else part)
    return "|".join(out)


def _value_apart(pattern: str) -> str:
    """A pattern of one group, with what comes before that group in a group of its own."""
    at = next(i for i in range(len(pattern)) if pattern[i] == "(" and pattern[i - 1 : i] != "\\" and pattern[i + 1] != "?")
    return f"({pattern[:at]}){pattern[at:]}"


#: Characters for private use that mark matches; texts that hold them have a blank in their place.
_MARKS = "\ue000\ue001\ue002"


def occurrences(text: Column, pattern: str, group: int = 0, at_value: bool = False) -> Column:
    """All matches from left to right: start and end (from 0, end exclusive; of the group if at_value), term (all of the match) and value (its group). Null for null text.

    One pass marks the matches in the text; what is between the marks adds up to the places. Texts without a match, most of them for most patterns, are only searched.
    """
    begin, middle, end = _MARKS
    dots = "(?s)" if pattern.startswith("(?s)") else ""
    pattern = quick(pattern.removeprefix(dots))
    lead, value = ("$1", f"${group + 1}") if at_value else ("", f"${group}")
    regex = ANY_CASE + dots + (_value_apart(pattern) if at_value else pattern)
    plain = F.regexp_replace(text, f"[{_MARKS}]", " ")
    marked = F.regexp_replace(plain, regex, f"{begin}{value}{middle}{lead}{middle}$0{end}")
    pieces = F.split(marked, begin)

    def add(done: Column, piece: Column) -> Column:
        said, ahead = F.substring_index(piece, middle, 1), F.char_length(F.substring_index(F.substring_index(piece, middle, 2), middle, -1))
        rest = F.substring_index(piece, middle, -1)
        term, gap = F.substring_index(rest, end, 1), F.char_length(F.substring_index(rest, end, -1))
        start = done["upto"] + ahead
        stop = start + F.char_length(said if at_value else term)
        one = F.struct(start.alias("start"), stop.alias("end"), term.alias("term"), said.alias("value"))
        return F.struct((done["upto"] + F.char_length(term) + gap).alias("upto"), F.concat(done["out"], F.array(one)).alias("out"))

    first = lambda p: F.struct(F.char_length(F.get(p, F.lit(0))).alias("upto"), F.array().cast(f"array<{OCCURRENCE}>").alias("out"))
    found = let(pieces, lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), first(p), add, lambda done: done["out"]))
    return F.when(plain.rlike(regex), found).when(text.isNotNull(), F.array().cast(f"array<{OCCURRENCE}>"))


def before(text: Column, o: Column, n: int) -> Column:
    """The n characters before an occurrence."""
    return F.substring(text, F.greatest(o["start"] - n, F.lit(0)) + 1, F.least(o["start"], F.lit(n)))


def after(text: Column, o: Column, n: int) -> Column:
    return F.substring(text, o["end"] + 1, F.lit(n))


def around(text: Column, o: Column, ahead: int, behind: int) -> Column:
    """The occurrence and what is around it."""
    start = F.greatest(o["start"] - ahead, F.lit(0))
    return F.substring(text, start + 1, o["end"] + behind - start)
