"""License scans: template markup compiled into token automata.

A template is the wording of a license or notice. `[[...]]` is optional,
`{{n}}` stands for up to n words of anyone's choosing, everything else is
mandatory word for word (`license_texts` has whole licenses and the notices
that stand for longer ones). Each becomes a nondeterministic automaton over words.
One Aho-Corasick pass over a text finds where a template's opening words stand;
the automaton then reads on from there and accepts if all mandatory wording
follows exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazelogic.llm.common import ascii_lower
from hazelogic.llm.decontam import WORD
from hazelogic.llm.license_texts import TEMPLATES

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}]+")
#: Opening words that the first pass looks for.
OPENING = 4


class Automaton:
    """States 0..accept; `step` by word, `any_word` to the next state, `skip` without a word."""

    def __init__(self, label: str, template: str):
        self.label, self.step, self.any_word, self.skip = label, {}, set(), {}
        self.mandatory, self.opening, open_ = 0, [], []
        state, leading = 0, True
        for part in _MARKUP.findall(template):
            if part == "[[":
                open_.append(state)
                leading = False
            elif part == "]]":
                self.skip.setdefault(open_.pop(), []).append(state)
            elif part.startswith("{{"):
                first = state
                for _ in range(int(part[2:-2])):
                    self.any_word.add(state)
                    state += 1
                for s in range(first, state):
                    self.skip.setdefault(s, []).append(state)
                leading = False
            else:
                for word in WORD.findall(ascii_lower(part)):
                    self.step[state] = word
                    state += 1
                    self.mandatory += not open_
                    if leading:
                        self.opening.append(word)
        if open_ or not self.opening:
            raise ValueError(f"{label}: a template begins with mandatory words and closes what it opens")
        self.accept, self.opening = state, self.opening[:OPENING]

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[str], at: int) -> int:
        """End of the longest accepted run of words from `at`, or -1."""
        states, end, i = self._closed({0}), -1, at
        while states:
            if self.accept in states:
                end = i
            if i == len(words):
                break
            w = words[i]
            states = self._closed({s + 1 for s in states if s in self.any_word or self.step.get(s) == w})
            i += 1
        return end


class Scanner:
    """The first pass over a text and the automata behind it."""

    def __init__(self, base: dict[str, str], templates: tuple[tuple[str, str], ...]):
        import ahocorasick

        self.base, self.automata = list(base.items()), [Automaton(*t) for t in templates]
        keys: dict[str, list[int]] = {}
        for i, (phrase, _) in enumerate(self.base):
            keys.setdefault(f" {phrase} ", []).append(-1 - i)
        for i, a in enumerate(self.automata):
            keys.setdefault(f" {' '.join(a.opening)} ", []).append(i)
        self.first = ahocorasick.Automaton()
        for k, v in keys.items():
            self.first.add_word(k, (len(k.split()), v))
        self.first.make_automaton()

    def scan(self, text: str | None) -> dict:
        """What stands in a text: places of base phrases and accepted templates."""
        words = WORD.findall(ascii_lower(text))
        joined = f" {' '.join(words)} "
        base: list[tuple[int, str]] = []
        found: list[tuple[int, int, str]] = []
        score, at, seen = 0.0, 0, 0
        for end, (n, own) in self.first.iter(joined):
            seen += joined.count(" ", at, end)  # spaces before the closing one: words up to here
            at = end
            begin = seen - n
            for k in own:
                if k < 0:
                    base.append((begin, self.base[-1 - k][1]))
                    score = max(score, 0.5)
                else:
                    a = self.automata[k]
                    if (stop := a.match(words, begin)) >= 0:
                        found.append((begin, stop, a.label))
                        score = max(score, a.mandatory / max(a.mandatory, stop - begin))
        return {"n_words": len(words), "base": base, "found": found, "score": score}


@lru_cache(maxsize=4)
def scanner(base: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(base), templates)


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<`begin`:long,`end`:long,label:string>>"


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and notices of every whole text.

    Returns doc_id, n_words, n_base (all places of base phrases), first_word
    and last_word (their smallest and largest first word, null without one),
    base_labels, labels (base and template labels, distinct, sorted, joined by
    commas), score (1 for mandatory wording alone, less the more optional or
    replaceable words a match has, 0.5 for base phrases alone, else 0) and
    matches (word ranges of accepted templates). Null and empty texts have no
    words and no labels; repeated rows are each returned; other columns are not
    read; an empty table gives an empty result.
    """
    fixed = tuple((BASE if base is None else base).items())
    kind = docs.schema[id_col].dataType.simpleString()
    match = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(fixed, templates)
        for b in batches:
            got = [s.scan(t) for t in b.column(1).to_pylist()]
            starts = [[x for x, _ in g["base"]] for g in got]
            labels = [{x for _, x in g["base"]} for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g["n_words"] for g in got], pa.int64()),
                    pa.array([len(x) for x in starts], pa.int64()),
                    pa.array([min(x, default=None) for x in starts], pa.int64()),
                    pa.array([max(x, default=None) for x in starts], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array([",".join(sorted(x | {f[2] for f in g["found"]})) for x, g in zip(labels, got, strict=True)], pa.string()),
                    pa.array([g["score"] for g in got], pa.float64()),
                    pa.array([[dict(zip(("begin", "end", "label"), f, strict=True)) for f in g["found"]] for g in got], match),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {_OUT}")
