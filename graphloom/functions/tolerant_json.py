"""JSON out of replies that are wrapped in prose, fenced, or cut off: what is complete before the fault is kept."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brackets that may be open at a time; what lies deeper is left out.
MAX_DEPTH = 100
_SPACE = re.compile(r"\s*")
_WORD = re.compile(r"(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?=[\s,\]}])")
_NOTHING = object()


class _Scanner:
    """One pass over a text; ``whole`` turns false at the first fault, and from then on brackets only close."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.whole = text, at, True
        self.cut: list[dict | list] = []

    def _skip(self) -> str:
        """The next character that is no space; empty at the end."""
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def _fault(self):
        self.whole = False
        return _NOTHING

    def _string(self):
        """A string that ends; control characters in it are taken as they are."""
        try:
            value, self.at = json.decoder.scanstring(self.text, self.at + 1, False)
        except ValueError:
            return self._fault()
        return value

    def value(self, depth: int = 0):
        c = self._skip()
        if c == '"':
            return self._string()
        if c in ("{", "["):
            return self._items(c, depth) if depth < MAX_DEPTH else self._fault()
        # a number or word counts if something follows it: at the end of a text it may be cut
        if not (m := _WORD.match(self.text, self.at)):
            return self._fault()
        self.at = m.end()
        return json.loads(m[0])

    def _items(self, c: str, depth: int):
        out: dict | list = {} if c == "{" else []
        self.at += 1
        while self.whole:
            c = self._skip()
            if c in ("}", "]"):
                if c != ("}" if isinstance(out, dict) else "]"):
                    self._fault()
                    break
                self.at += 1
                break
            if c == ",":
                self.at += 1
                continue
            key = None
            if isinstance(out, dict):
                key = self._string() if c == '"' else self._fault()
                if not self.whole or self._skip() != ":":
                    self._fault()
                    break
                self.at += 1
            v = self.value(depth + 1)
            # a container that was cut counts with what it holds; a scalar that was cut does not
            if v is _NOTHING or (not self.whole and not v):
                break
            if isinstance(out, dict):
                out[key] = v
            else:
                out.append(v)
        if not self.whole:
            self.cut.append(out)
        return out


def loads(text: str | None, opening: str = "{["):
    """:func:`scan` without the list of what was cut."""
    return scan(text, opening)[0]


def scan(text: str | None, opening: str = "{[") -> tuple[dict | list | None, list]:
    """The value, and those of its objects and arrays that are not whole. The value is the first object or array in a text that holds something, its complete items before a fault if it has one; None without one.

    ``opening`` has the brackets that it may start with. Of prose and fences around it nothing is kept; commas may be too many; an empty object or array counts if there is no other.
    """
    text = text or ""
    empty, at = None, 0
    start = re.compile(f"[{re.escape(opening)}]")
    while m := start.search(text, at):
        s = _Scanner(text, m.start())
        got = s.value()
        if got is not _NOTHING and got:
            return got, s.cut
        if s.whole and empty is None:
            empty = got
        at = m.end()
    return empty, []


def repaired(reply: Column, opening: str = "{[") -> Column:
    """A column of replies as valid JSON texts, for ``from_json``; null where there is none."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([None if (v := loads(x, opening)) is None else json.dumps(v, ensure_ascii=False) for x in s], dtype=object)

    return run(reply)


def report(reply: Column) -> Column:
    """struct(title, summary, findings: array of (statement, importance)) of a community report's reply.

    Without JSON, or without a summary in it, the summary is the trimmed reply; findings without a statement are left out,
    an importance that is no number is 0.
    """
    raw = F.trim(F.coalesce(reply, F.lit("")))
    r = F.from_json(repaired(raw, "{"), "title string, summary string, findings array<struct<statement:string,importance:string>>")
    listed = F.filter(F.coalesce(r["findings"], F.array()), lambda x: F.trim(F.coalesce(x["statement"], F.lit(""))) != "")
    findings = F.transform(listed, lambda x: F.struct(F.trim(x["statement"]).alias("statement"), F.coalesce(x["importance"].try_cast("int"), F.lit(0)).alias("importance")))
    return F.struct(F.trim(F.coalesce(r["title"], F.lit(""))).alias("title"), F.trim(F.coalesce(r["summary"], raw)).alias("summary"), findings.alias("findings"))
