"""License scans by template matching.

A template is wording with markup: ``<<optional>>...<</optional>>`` may be left out, ``<<any:n>>`` stands for up to n words.
It is compiled into an automaton over words; a text is accepted where the mandatory wording stands word for word.
Phrases (the base) are templates without markup. Only texts that hold a template's rarest-looking mandatory word, found
by a byte search, are run through its automaton; word numbers come from a vectorised scan of whole batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces, word_spans

# Phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# License wording with optional and replaceable regions, and labels.
TEMPLATES = (
    ("released <<optional>>to the public<</optional>> under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this <<any:6>> and associated "
     "documentation files", "mit"),
    ("licensed under the apache license version 2 <<optional>>0<</optional>>", "apache-2"),
    ("licensed under <<optional>>the<</optional>> <<optional>>creative commons<</optional>> cc by nc "
     "<<optional>>4 0<</optional>>", "cc-by-nc"),
    ("licensed under <<optional>>the<</optional>> creative commons attribution noncommercial <<any:3>> license", "cc-by-nc"),
    ("<<optional>>this work is<</optional>> licensed under the gnu general public license <<optional>>version<</optional>> 3", "gpl-3"),
    ("licensed under the gnu lesser general public license <<any:4>> version <<any:1>>", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted <<optional>>provided "
     "that the following conditions are met<</optional>>", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)

GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Machine:
    """States are places in the token list. ``skip[i]``: places reachable from i without reading a word."""

    tokens: tuple  # word, or None for any word
    skip: tuple
    label: str
    mandatory: tuple
    needle: bytes
    starts: frozenset

    def run(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted wording that begins at word ``at``, or -1."""
        here, end = set(self.skip[0]), -1
        for i in range(at, len(words) + 1):
            if len(self.tokens) in here:
                end = i
            if i == len(words):
                break
            new: set[int] = set()
            for s in here:
                if s < len(self.tokens) and self.tokens[s] in (None, words[i]):
                    new.update(self.skip[s + 1])
            if not new:
                break
            here = new
        return end


def compile_template(text: str, label: str) -> Machine:
    tokens: list = []
    jumps: dict[int, set[int]] = {}
    opened: list[int] = []
    for part in re.findall(r"<</?\w+(?::\d+)?>>|[^\s<>]+", text):
        if part == "<<optional>>":
            opened.append(len(tokens))
        elif part == "<</optional>>":
            jumps.setdefault(opened.pop(), set()).add(len(tokens))
        elif part.startswith("<<any:"):
            n = int(part[6:-2])
            for i in range(n):
                jumps.setdefault(len(tokens) + i, set()).add(len(tokens) + n)
            tokens += [None] * n
        else:
            tokens.append(part.lower().encode())
    if opened:
        raise ValueError(f"unclosed region in {text!r}")
    skip = []
    for i in range(len(tokens) + 1):
        seen, todo = {i}, [i]
        while todo:
            for j in jumps.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        skip.append(tuple(sorted(seen)))
    covered = {k for a, ends in jumps.items() for b in ends for k in range(a, b)}
    mandatory = tuple(t for i, t in enumerate(tokens) if i not in covered and t is not None)
    if not mandatory:
        raise ValueError(f"no mandatory wording in {text!r}")
    starts = frozenset(tokens[s] for s in skip[0] if s < len(tokens) and tokens[s] is not None)
    return Machine(tuple(tokens), tuple(skip), label, mandatory, max(mandatory, key=len), starts)


def _scan_rows(base, templates, columns):
    base = [(p.encode().split(), label) for p, label in base]
    machines = [compile_template(t, label) for t, label in templates]
    phrases = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(map(re.escape, p)) + rb"(?![0-9a-z\x80-\xff])"),
                max(p, key=len), label) for p, label in base]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            ends: list = [[None] * n, [None] * n]
            names: list = [[""] * n, [""] * n]
            score = np.zeros(n)
            for p in pieces(batch.column("text")):
                data = LOWER[p.data]
                a, _, first = word_spans(data, p.start, p.end, GAP)
                n_words[p.row] = np.diff(first)
                whole = data.tobytes()
                held = {}
                for needle in {x for _, x, _ in phrases} | {m.needle for m in machines}:
                    at = [m.start() for m in re.finditer(re.escape(needle), whole)]
                    held[needle] = set(np.unique(np.searchsorted(p.start, at, "right") - 1).tolist()) if at else set()
                for i in sorted(set().union(*held.values())):
                    text, r = whole[p.start[i] : p.end[i]], p.row[i]
                    places, labels = [], set()
                    for pattern, needle, label in phrases:
                        if i in held[needle]:
                            at = pattern.search(text)
                            while at:  # from the next byte on, as places may overlap
                                places.append(int(np.searchsorted(a, p.start[i] + at.start())) - int(first[i]))
                                labels.add(label)
                                at = pattern.search(text, at.start() + 1)
                    found, best = set(labels), 0.0
                    words = None
                    for m in machines:
                        if i in held[m.needle]:
                            words = words if words is not None else _WORD.findall(text)
                            for k, w in enumerate(words):
                                if w in m.starts and m.run(words, k) > k:
                                    found.add(m.label)
                                    best = 1.0
                                    break
                            if best < 1:
                                best = max(best, _share(m, words))
                    n_base[r] = len(places)
                    if places:
                        ends[0][r], ends[1][r] = min(places), max(places)
                    names[0][r], names[1][r] = ",".join(sorted(labels)), ",".join(sorted(found))
                    score[r] = 1.0 if labels else best
            yield pa.record_batch([*[batch.column(c) for c in columns], pa.array(n_words), pa.array(n_base),
                                   pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64()), pa.array(names[0]), pa.array(names[1]),
                                   pa.array(score)], names=[*columns, "n_words", "n_base", "first_word", "last_word", "base_labels",
                                                            "labels", "score"])

    return rows


def _share(m: Machine, words: list[bytes]) -> float:
    """For wording that is not accepted: half the share of mandatory words found in order after the rarest one's place."""
    best = 0
    lead = m.mandatory.index(m.needle)
    for k, w in enumerate(words):
        if w == m.needle:
            n, at = 1, k + 1
            for t in m.mandatory[lead + 1 :]:
                if at < len(words) and words[at] == t:
                    n, at = n + 1, at + 1
            best = max(best, n)
    return 0.5 * best / len(m.mandatory)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), base=BASE, templates=TEMPLATES) -> DataFrame:
    """Columns ``keep`` plus n_words, n_base, first_word, last_word, base_labels, labels and score, one row per row.

    Words are runs of ASCII letters and digits and of bytes above 0x7F, A-Z lower-cased. Nulls are empty: no words, no
    places, empty labels, score 0. The score is 1 where a phrase or template is met, else below. No shuffle takes place.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.withColumnRenamed("__text", "text").mapInArrow(
        _scan_rows(base, templates, tuple(keep)),
        schema + ", n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
