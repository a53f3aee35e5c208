"""License scans with a positional rare-token index.

The index keeps, for each license template, its words of highest inverse document frequency over the templates and a
background of frequent English words, with their positions. A file is looked up by the rare words it holds; each hit
votes for the place where the template would begin. Where enough postings agree within a few words, for words may have
been put in or left out between them, the place is verified: the share of template words that stand there in order, and
the template's mandatory key phrase. Beside a place, no phrase may stand that makes it another licence, as noncommercial
beside an attribution licence; a short notice may hold filler words only, and no word that denies it may stand before
it. Labels are joined with those of plain phrases found anywhere.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lexmill.llm.common import ALNUM, append, table
from lexmill.llm.license_texts import BACKGROUND, FILLERS, NEGATIONS, TEMPLATES, forbidden

# Phrase and label of the base scan.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Params:
    rare_words: int = 8  # of each template, in its postings
    votes: float = 0.5  # share of a template's postings that must agree on a place
    share: float = 0.8  # of template words that stand in order
    short: int = 16  # words up to which a template is a notice, whose words stand together
    drift: float = 0.1  # share of a template's length by which places of its postings may differ, and of words put in


def in_order(wanted: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """The longest common subsequence of a template of n words (bits of the places of each) and words, by bits."""
    full = rest = (1 << n) - 1
    for w in words:
        if m := wanted.get(w, 0) & rest:
            rest = (rest + m | rest - m) & full
    return n - rest.bit_count()


class Index:
    """Templates as words, and postings word -> [(template, position)] of each template's rarest words."""

    def __init__(self, templates=tuple(TEMPLATES), p: Params = Params()) -> None:
        self.p, self.labels = p, [t[0] for t in templates]
        self.keys = [b" " + t[1].encode() + b" " for t in templates]
        words = [ALNUM.words(t[2].encode()) for t in templates]
        self.sizes = [len(w) for w in words]
        df = Counter(w for ws in words for w in set(ws)) + Counter({w.encode(): len(words) for w in BACKGROUND})
        idf = {w: math.log((2 * len(words) + 1) / (n + 1)) for w, n in df.items()}
        self.postings, self.needed, self.places = defaultdict(list), [], []
        for t, ws in enumerate(words):
            rare = sorted(set(ws), key=lambda w: (-idf[w], -len(w), w))[: p.rare_words]
            hits = [(i, w) for i, w in enumerate(ws) if w in rare]
            for i, w in hits:
                self.postings[w].append((t, i))
            self.needed.append(max(1, math.ceil(p.votes * len(hits))))
            bits: dict[bytes, int] = defaultdict(int)
            for i, w in enumerate(ws):
                bits[w] |= 1 << i
            self.places.append(dict(bits))
        self.postings = dict(self.postings)
        self.forbidden = [[f" {x} ".encode() for x in forbidden(label)] for label in self.labels]
        fillers = {x.encode() for x in FILLERS}
        self.fillers, self.negations = fillers, {x.encode() for x in NEGATIONS}
        self.tight = [[w for w in ws if w not in fillers] if len(ws) <= p.short else None for ws in words]
        self.drift = [max(2, math.ceil(p.drift * n)) for n in self.sizes]

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates found in a file's words, and the largest verified share."""
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in [i for i, w in enumerate(words) if w in self.postings]:
            for t, at in self.postings[words[i]]:
                votes[t].append((i - at, at))
        labels, best = set(), 0.0
        for t, cast in votes.items():
            for start in self.agreed(t, cast):
                share = self.verified(t, start, words)
                if share >= self.p.share:
                    labels.add(self.labels[t])
                    best = max(best, share)
        return labels, best

    def agreed(self, t: int, cast: list[tuple[int, int]]):
        """Places where enough postings agree within the drift, in order; places nearer than half of it are one."""
        if len(cast) < self.needed[t]:
            return
        cast.sort()
        low, held, last = 0, Counter(), None
        for start, at in cast:
            held[at] += 1
            while cast[low][0] < start - self.drift[t]:
                held[cast[low][1]] -= 1
                if not held[cast[low][1]]:
                    del held[cast[low][1]]
                low += 1
            if len(held) >= self.needed[t] and (last is None or cast[low][0] - last > self.drift[t] // 2):
                last = cast[low][0]
                yield last

    def verified(self, t: int, start: int, words: list[bytes]) -> float:
        """The share of the template's words in order about a place, 0 without its key phrase."""
        have = words[max(0, start - self.drift[t]) : max(0, start + self.sizes[t] + 2 * self.drift[t])]
        line = b" " + b" ".join(have) + b" "
        if self.keys[t] not in line or any(x in line for x in self.forbidden[t]) or not self.stands(t, start, words, have):
            return 0.0
        return in_order(self.places[t], self.sizes[t], have) / self.sizes[t]


    def stands(self, t: int, start: int, words: list[bytes], have: list[bytes]) -> bool:
        """Whether a notice's words stand together, but for fillers, and undenied; longer texts need no such test."""
        wanted = self.tight[t]
        if wanted is None:
            return True
        before = (b" " + b" ".join(have)).partition(self.keys[t].rstrip())[0].split()
        if not self.negations.isdisjoint(words[max(0, start - self.drift[t] - 3) : max(0, start - self.drift[t])] + before):
            return False
        have, enough = [w for w in have if w not in self.fillers], math.ceil(self.p.share * len(wanted))
        return any(sum(map(bytes.__eq__, wanted, have[i:])) >= enough for i in range(max(0, len(have) - enough) + 1))


def phrase_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Starts of every base phrase, from word 0, and their labels."""
    line, starts, labels = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in PHRASES.items():
        wanted, at = b" " + phrase.encode() + b" ", -1
        found = []
        while (at := line.find(wanted, at + 1)) >= 0:
            found.append(at)
        if found:
            blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
            starts += np.searchsorted(blanks, found).tolist()
            labels.add(label)
    return starts, labels


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), params: Params = Params()) -> DataFrame:
    """The columns in keep, then n_words, n_base, first_word, last_word, base_labels, labels and score, a row for each
    row of docs. score is the largest share of a template's words found in order, 0 if no template
    is found.

    Null and empty texts have no words, no places (first_word and last_word null) and empty labels. Other columns are
    not read.
    """

    def make():
        index = Index(p=params)

        def run(texts):
            rows = []
            for text in texts:
                words = ALNUM.words(text or b"")
                starts, base = phrase_places(words)
                found, share = index.scan(words)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), share))
            return rows

        return run

    return append(docs, text_col, make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", list(keep))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
