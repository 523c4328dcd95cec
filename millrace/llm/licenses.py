"""License scans with template markup.

Templates are license wording with optional regions ``<<beginOptional>> .. <<endOptional>>`` (they nest) and
replaceable ones ``<<var;name="..";original="..";match=".{0,5}">>``, which accept that many words of any kind. Each
template compiles into an automaton over words; a place in a text is accepted when the mandatory wording matches word
for word. Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters, so punctuation is no matter.

Phrases are templates without regions. Defined cases: a null or empty text has no words and no labels; places may
overlap and each start counts; rows are independent, so repeated rows and ties need no rule; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from .batches import per_text

#: The phrases every scan looks for, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label; a label may have several.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        '<<beginOptional>>released under<<endOptional>> <<beginOptional>>licensed under<<endOptional>> the MIT license',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="subject";original="this software and associated documentation files";match=".{1,8}">> '
        '(the <<var;name="short";original="Software";match=".{1,2}">>), to deal in the <<var;name="short";original="Software";match=".{1,2}">> without restriction',
    ],
    "apache-2.0": [
        '<<beginOptional>>licensed<<endOptional>> under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>',
    ],
    "apache": ['under the Apache License<<beginOptional>>, Version <<var;name="version";original="2.0";match=".{1,2}">><<endOptional>>'],
    "gpl": [
        '<<beginOptional>>licensed<<endOptional>> under the terms of the <<beginOptional>>GNU<<endOptional>> <<beginOptional>>Lesser<<endOptional>> General Public License',
    ],
    "gpl-version": [
        'GNU General Public License <<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> version <<var;name="version";original="3";match=".{1,1}">> '
        '<<beginOptional>>of the License<<endOptional>> <<beginOptional>>, or (at your option) any later version<<endOptional>>',
    ],
    "cc-by-nc": ['CC BY-NC <<var;name="version";original="4.0";match=".{0,2}">>', 'Creative Commons Attribution-NonCommercial <<var;name="version";original="4.0";match=".{0,2}">> <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>'],
    "cc-by-sa": ['CC BY-SA <<var;name="version";original="4.0";match=".{0,2}">>', 'Creative Commons Attribution-ShareAlike <<var;name="version";original="4.0";match=".{0,2}">> <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>'],
    "cc-by": ['Creative Commons Attribution <<var;name="version";original="4.0";match=".{0,2}">> <<beginOptional>>International<<endOptional>> License'],
    "cc0": ['CC0 <<var;name="version";original="1.0";match=".{0,2}">> <<beginOptional>>Universal<<endOptional>> <<beginOptional>>Public Domain Dedication<<endOptional>>'],
    "bsd": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met',
        '<<beginOptional>>licensed<<endOptional>> under the <<beginOptional>><<var;name="clauses";original="3-clause";match=".{1,2}">><<endOptional>> BSD license',
    ],
    "isc": ['Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted'],
    "mpl-2.0": ['subject to the terms of the Mozilla Public License, <<beginOptional>>v.<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0'],
    "unlicense": ['This is free and unencumbered software released into the public domain'],
}

TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TAG = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_MATCH = re.compile(r'match="\.\{(\d+),(\d+)\}"')


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Automaton:
    """States joined by words, by any word, and by empty steps."""

    def __init__(self, template: str) -> None:
        self.words: list[dict[bytes, int]] = []
        self.any: list[int | None] = []
        self.empty: list[list[int]] = []
        self.mandatory: list[bytes] = []
        at, opened = self._state(), []
        for k, part in enumerate(_TAG.split(template)):
            if k % 2 == 0:
                for word in words_of(part.encode()):
                    self.words[at][word] = nxt = self._state()
                    at = nxt
                    if not opened:
                        self.mandatory.append(word)
            elif part == "beginOptional":
                opened.append(at)
            elif part == "endOptional":
                start, end = opened.pop(), self._state()
                self.empty[at].append(end)
                self.empty[start].append(end)
                at = end
            else:
                least, most = map(int, _MATCH.search(part).groups())
                skip, done = [], None
                for n in range(most):
                    if n >= least:
                        skip.append(at)
                    self.any[at] = nxt = self._state()
                    at = nxt
                done = self._state()
                for state in (*skip, at):
                    self.empty[state].append(done)
                at = done
        if opened or not self.mandatory:
            raise ValueError(f"not a template with mandatory words and closed regions: {template!r}")
        self.final = at
        self.closure = [self._closed(s) for s in range(len(self.words))]
        self.first = {w for s in self.closure[0] for w in self.words[s]}
        self.starts_anyhow = any(self.any[s] is not None for s in self.closure[0])
        self.rarest = max(self.mandatory, key=len)

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.empty.append([])
        return len(self.words) - 1

    def _closed(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def longest(self, words: list[bytes], start: int) -> tuple[int, int] | None:
        """End of the longest accepted run from ``start``, and the least number of its words that are replaceable."""
        states, best = {s: 0 for s in self.closure[0]}, None
        for i in range(start, len(words)):
            after: dict[int, int] = {}
            for s, loose in states.items():
                steps = [(self.words[s].get(words[i]), loose), (self.any[s], loose + 1)]
                for target, n in steps:
                    if target is not None:
                        for t in self.closure[target]:
                            after[t] = min(n, after.get(t, n))
            if not after:
                break
            if self.final in after:
                best = (i + 1, after[self.final])
            states = after
        return best


def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in templates]


def places(words: list[bytes], automata: list[tuple[str, Automaton]], joined: bytes) -> list[tuple[str, int, int, int]]:
    """(label, start, end, replaceable words) of every start at which a template is accepted."""
    found = []
    for label, a in automata:
        if a.rarest not in joined:
            continue
        for i, w in enumerate(words):
            if (w in a.first or a.starts_anyhow) and (hit := a.longest(words, i)):
                found.append((label, i, *hit))
    return found


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, list[str]] = TEMPLATES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``places``.

    n_base, first_word and last_word are about the phrases: number of places, smallest and largest start (words from
    0). ``score`` is the largest share of fixed wording among the accepted places, 0 without any. ``places`` lists
    label, start word and end word of all of them.
    """
    base = tuple((label, phrase) for phrase, label in phrases.items())
    more = tuple((label, t) for label, ts in templates.items() for t in ts)

    def make() -> Callable[[bytes], tuple]:
        base_automata, more_automata = compiled(base), compiled(more)

        def scan(text: bytes) -> tuple:
            joined = text.translate(TO_WORDS)
            words = joined.split()
            own, other = places(words, base_automata, joined), places(words, more_automata, joined)
            starts = [s for _, s, _, _ in own]
            every = sorted({(s, e, x) for x, s, e, _ in own + other})
            return (len(words), len(own), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x for x, *_ in own})), ",".join(sorted({x for x, *_ in own + other})),
                    max((1 - loose / (e - s) for _, s, e, loose in own + other), default=0.0),
                    [{"label": x, "start": s, "end": e} for s, e, x in every])

        return scan

    return per_text(docs, make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                    "score double, places array<struct<label string, start long, end long>>", id_col, text_col)
