"""License scans: phrases of the contract, and templates with optional and replaceable regions as token automata.

A template is text with the markup `<<optional>> ... <<end>>` (may be left out) and `<<any:N>>` (up to N words of any
kind). It compiles into an automaton over words; a text is accepted where the mandatory words stand exactly in order.
Only words that can begin a template start a run of its automaton, and only in texts that hold its longest mandatory
word. license_texts.py has the templates: whole licenses and the notices that files carry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm.common import chunks, table
from tallygrid.llm.license_texts import TEMPLATES

#: Fixed values of the contract: (phrase, label).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Automaton:
    """States are places in the template; `step` maps a set of states and a word to the next set. State -1 accepts."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.moves: list[list[tuple[str | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for part in re.findall(r"<<[a-z]+(?::\d+)?>>|[^\s<]+", template):
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<<end>>":
                self.skips[opened.pop()].append(at)
            elif part.startswith("<<any:"):
                first = at
                for _ in range(int(part[6:-2])):
                    at = self._after(at, None)
                for state in range(first, at):
                    self.skips[state].append(at)
            else:
                at = self._after(at, part)
        if opened:
            raise ValueError(f"an optional region isn't closed: {template}")
        self.last = at
        self.start = self._closed({0})
        self.begins = {w for s in self.start for w, _ in self.moves[s]}
        if None in self.begins or self.last in self.start:
            raise ValueError(f"a template must begin with a word: {template}")

    def _after(self, at: int, word: str | None) -> int:
        self.moves.append([])
        self.skips.append([])
        self.moves[at].append((word, len(self.moves) - 1))
        return len(self.moves) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[str], at: int) -> int:
        """Words of the longest match that starts at word `at`; 0 if none."""
        states, best = self.start, 0
        for k in range(at, len(words)):
            states = self._closed({to for s in states for word, to in self.moves[s] if word is None or word == words[k]})
            if not states:
                break
            if self.last in states:
                best = k + 1 - at
        return best


def word_table() -> np.ndarray:
    """Byte to byte: A-Z lower-cased, what belongs to no word to a space. Bytes of non-ASCII characters belong to words."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        out[lo : hi + 1] = 32
    return out


def scanner(phrases=PHRASES, templates=TEMPLATES):
    """A function for mapInArrow from doc_id and text to SCHEMA."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(*t) for t in templates]
        begins: dict[str, list[Automaton]] = {}
        for a in automata:
            for w in a.begins:
                begins.setdefault(w, []).append(a)
        edge = rb"[0-9a-z\x80-\xff]"
        exact = [(re.compile(rb"(?<!%s)%s(?!%s)" % (edge, rb" +".join(p.encode().split()), edge)), label, p.split()[0].encode()) for p, label in phrases]
        #: Each template's rarest-looking mandatory word must stand in a text before its words are listed.
        needs = sorted({max((w for w in re.sub(r"<<optional>>.*?<<end>>|<<any:\d+>>", " ", t).split()), key=len).encode() for _, t in templates})
        words_of = word_table()
        for batch in batches:
            ids, cols = batch.column(0), [[] for _ in range(7)]
            for _, _, data, at in chunks(batch.column(1)):
                low = words_of[data]
                inside = low != 32
                starts = inside.copy()
                starts[1:] &= ~inside[:-1]
                first = at[:-1][at[1:] > at[:-1]]
                starts[first] = inside[first]
                places = np.flatnonzero(starts)
                ends = np.searchsorted(places, at)
                buffer = low.tobytes()
                for r in range(len(at) - 1):
                    text, n = buffer[at[r] : at[r + 1]], int(ends[r + 1] - ends[r])
                    found, base = [], set()
                    for rx, label, word in exact:
                        if word in text:
                            for m in rx.finditer(text):
                                found.append(int(np.searchsorted(places, at[r] + m.start())) - int(ends[r]))
                                base.add(label)
                    labels, score = set(base), 0.5 if base else 0.0
                    if any(w in text for w in needs):
                        words = [w.decode("utf-8", "replace") for w in text.split(b" ") if w]
                        for k, w in enumerate(words):
                            for a in begins.get(w, ()):
                                if a.label not in labels or score < 1:
                                    if a.match(words, k):
                                        labels.add(a.label)
                                        score = 1.0
                    row = (n, len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return scan


def scan_licenses(documents: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row for each row of documents (doc_id and text; other columns are ignored).

    Words: A-Z lower-cased, runs of letters, digits and non-ASCII characters. n_base counts all places of phrases,
    first_word and last_word are their smallest and largest start (null if there is none). labels adds those of the
    templates. score: 1 if a template accepts a place, 0.5 if only phrases stand, else 0. A null or empty text has no
    words and empty labels. Rows that repeat give a row each; texts are read whole, very long ones in a chunk of their own.
    """
    return documents.select("doc_id", "text").mapInArrow(scanner(phrases, templates), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
