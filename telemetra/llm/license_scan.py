"""License scans: template markup compiled to token automata.

A template is license wording with two kinds of regions: ``[[...]]`` may be missing, and
``{{n}}`` stands for up to ``n`` words of any wording (names, years, version numbers). The
mandatory rest has to match word for word. All templates compile into one automaton over
words whose states are followed together while a text's words go by; an accepted place is
the template's first start that reaches the end. Text goes through whole.

Defined cases: a null or empty text has no words, no places and a score of 0. Repeated rows
are scanned one by one; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm.common import map_rows

# Fixed values of the query: phrase and label.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# The method's own templates: label and markup.
TEMPLATES = [
    ("gpl-notice", "[[this work is]] {{2}} licensed under [[the]] [[terms of the]] gnu [[lesser]] general public license [[as published by the free software foundation]] [[either]] version {{1}}"),
    ("gpl-or-later", "gnu general public license as published by the free software foundation either version {{2}} of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]]"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "released under the [[terms of the]] mit license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-notice", "licensed under [[a]] [[the]] [[creative commons]] {{4}} cc by [[nc]] [[sa]] [[nd]] [[{{2}} international]]"),
    ("cc-notice", "creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] {{2}} [[international]] license"),
    ("reserved", "all rights reserved"),
]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with only A-Z lower-cased, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Token automaton of several templates.

    ``on[state]`` maps a word to next states, ``any_of[state]`` holds the next states on any
    word; moves without a word are closed over when the automaton is built."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.on: list[dict[bytes, set[int]]] = []
        self.any_of: list[set[int]] = []
        self.free: list[set[int]] = []
        self.ends: dict[int, int] = {}
        self.labels = [label for label, _ in templates]
        self.starts: dict[bytes, set[int]] = defaultdict(set)
        for no, (_, markup) in enumerate(templates):
            first = self._state()
            marks = _MARK.findall(markup)
            last, used = self._sequence(marks, 0, first)
            if used != len(marks):
                raise ValueError(f"unbalanced region in template {markup!r}")
            self.ends[last] = no
            if self._closure({first}) & {last}:
                raise ValueError(f"template without mandatory words: {markup!r}")
            for state in self._closure({first}):
                for word, following in self.on[state].items():
                    self.starts[word] |= following
        self.next = [self._closure({s}) for s in range(len(self.on))]

    def _state(self) -> int:
        self.on.append(defaultdict(set))
        self.any_of.append(set())
        self.free.append(set())
        return len(self.on) - 1

    def _sequence(self, marks: list[str], i: int, at: int) -> tuple[int, int]:
        while i < len(marks) and marks[i] != "]]":
            mark, new = marks[i], self._state()
            if mark == "[[":
                inner, i = self._sequence(marks, i + 1, at)
                if i >= len(marks):
                    raise ValueError("unbalanced region in template")
                self.free[inner].add(new)
                self.free[at].add(new)
            elif mark.startswith("{{"):
                self.free[at].add(new)
                for _ in range(int(mark[2:-2])):
                    step = self._state()
                    self.any_of[at].add(step)
                    self.free[step].add(new)
                    at = step
            else:
                self.on[at][mark.encode()].add(new)
            at, i = new, i + 1
        return at, i

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepted(self, words: list[bytes], begin: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, template) of each accepted place: per template and start the shortest
        accepted end. ``begin`` holds the positions whose word can start a template."""
        found = []
        for start in begin:
            states = self.starts[words[start]]
            at, done = start + 1, set()
            while states:
                states = set().union(*(self.next[s] for s in states))
                for s in states & self.ends.keys():
                    if self.ends[s] not in done:
                        done.add(self.ends[s])
                        found.append((start, at, self.ends[s]))
                if at == len(words):
                    break
                word = words[at]
                states = set().union(*(self.on[s].get(word, set()) | self.any_of[s] for s in states))
                at += 1
        return found


RESULT = "n_words bigint, places array<struct<start:int,end:int,template:int>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words`` and the accepted ``places`` (word offsets, end
    exclusive, number of the template)."""
    machine = Automaton(templates)
    firsts = set(machine.starts)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(RESULT).fields])

    def fn(cols: list[list]) -> list[list]:
        sizes, places = [], []
        for text in cols[1]:
            words = words_of(text)
            sizes.append(len(words))
            begin = [i for i, w in enumerate(words) if w in firsts] if not firsts.isdisjoint(words) else []
            places.append([dict(start=s, end=e, template=t) for s, e, t in sorted(machine.accepted(words, begin))])
        return [cols[0], sizes, places]

    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), schema, fn)
