"""License scans: matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds every factor of the templates' token sequences.  A text is streamed through it
once; at each word the state gives the longest run of words ending there that some template contains.
Long maximal runs are chained, per template, into spans in which both positions move forward, and a span
that covers enough of its template gives the template's label.  Only runs of known words can hold
a long match, so the automaton runs there alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.license_texts import TEMPLATES
from inkwarden.llm.runtime import bound_batches, plain_words, text_of

#: (phrase, label): the fixed phrases whose places are counted.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

class Automaton:
    """Generalised suffix automaton over token lists; `ends[state]` has all ends of the state's strings in each
    template, in order."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for number, tokens in enumerate(templates):
            last = 0
            for end, token in enumerate(tokens, 1):
                last = self._extend(last, token)
                self.ends[last].setdefault(number, set()).add(end)
        for s in sorted(range(1, len(self.length)), key=lambda x: -self.length[x]):
            if self.link[s] > 0:
                up = self.ends[self.link[s]]
                for number, places in self.ends[s].items():
                    up.setdefault(number, set()).update(places)
        self.ends = [{number: sorted(places) for number, places in x.items()} for x in self.ends]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, token: int) -> int:
        """The state of p's string and token, cut off from a longer one if need be."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = self._split(p, token) if p >= 0 else 0
        return new

    def maximal(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of matches of at least `least` tokens that the next token ends."""
        out, state, length = [], 0, 0
        for at, token in enumerate(tokens):
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
                continue
            if length >= least:
                out.append((at, length, state))
            while state > 0 and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
        if length >= least:
            out.append((len(tokens), length, state))
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, least: int = 4, gap: int = 8, cover: float = 0.8):
        self.least, self.gap, self.cover = least, gap, cover
        lists = [plain_words(t) for _, t in templates]
        phrase_lists = [plain_words(p) for p, _ in phrases]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for x in (*lists, *phrase_lists) for w in x), 1)}
        self.labels, self.sizes = [x for x, _ in templates], [len(x) for x in lists]
        self.automaton = Automaton([[self.ids[w] for w in x] for x in lists])
        self.phrases = [(np.array([self.ids[w] for w in x]), label) for x, (_, label) in zip(phrase_lists, phrases, strict=True)]
        self.shortest = min([least, *(len(x) for x in phrase_lists)])

    def spans(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Chains of (end, length, state): in one template both positions move on, by a gap of at most
        `gap` words more than the match; a match that the template repeats takes its next place in the chain.  One
        span per chain that covers enough of the template."""
        open_: dict[int, list] = {}
        done = []

        def close(number: int) -> None:
            start, end, covered, _ = open_.pop(number)
            done.append((number, start, end, min(1.0, covered / self.sizes[number])))

        for end, length, state in sorted(matches):
            for number, places in self.automaton.ends[state].items():
                t_end = places[0]
                if chain := open_.get(number):
                    later = bisect_right(places, chain[3])
                    t_end = places[later] if later < len(places) else places[-1]
                    lost = max(0, chain[1] - (end - length), chain[3] - (t_end - length))  # overlap counts once
                    if length > lost and end - length - chain[1] <= self.gap and chain[3] < t_end:
                        open_[number] = [chain[0], end, chain[2] + length - lost, t_end]
                        continue
                    close(number)
                    t_end = places[0]
                open_[number] = [end - length, end, length, t_end]
        for number in list(open_):
            close(number)
        return [{"label": self.labels[n], "template": n, "start": s, "end": e, "coverage": c} for n, s, e, c in sorted(done, key=lambda x: (x[1], x[0]))]

    def scan(self, text: str) -> dict:
        words = plain_words(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, (ids > 0).view(np.int8), 0]))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        places: list[int] = []
        labels: set[str] = set()
        matches: list[tuple[int, int, int]] = []
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            run = ids[start:end]
            for phrase, label in self.phrases:
                n = len(run) - len(phrase) + 1
                if n > 0:
                    fits = run[:n] == phrase[0]
                    if fits.any():
                        for k in range(1, len(phrase)):
                            fits = fits & (run[k : k + n] == phrase[k])
                        if fits.any():
                            places += (np.flatnonzero(fits) + start).tolist()
                            labels.add(label)
            if end - start >= self.least:
                matches += [(start + e, n, s) for e, n, s in self.automaton.maximal(run.tolist(), self.least)]
        spans = self.spans(matches)
        found = [s for s in spans if s["coverage"] >= self.cover]
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s["label"] for s in found})),
            "score": max((s["coverage"] for s in spans), default=0.0), "spans": [{k: s[k] for k in ("label", "start", "end", "coverage")} for s in found],
        }


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,coverage:double>>"


def scan(df: DataFrame, text: str = "text", out: str = "license", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """df with the struct `out` (RESULT): words, places of PHRASES and their first and last word, base
    labels, all labels (distinct, sorted, comma-joined), score (the largest coverage of a template
    by a chain, 0 to 1) and the covered spans (word offsets, end exclusive).

    Null and empty texts have no words, null places, empty labels and score 0.  Repeated rows keep their
    rows; an empty table stays empty; a column named `out` is replaced; no row leaves its partition.
    """
    bound_batches(df.sparkSession)
    state: list[Scanner] = []

    @F.pandas_udf(RESULT)
    def scans(texts: pd.Series) -> pd.DataFrame:
        if not state:
            state.append(Scanner(templates=templates))
        rows = pd.DataFrame([state[0].scan(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        return rows.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return df.withColumn(out, scans(text_of(text)))
