"""Licence scans: passages compared to licence templates by Dice coefficient over word bigrams.

A passage is a window of words of the whole text, across line ends. Dice >= t bounds the number of bigrams of a
window that a template of known size can match: a text is looked at only for templates of which it
holds enough bigrams, and windows of it only from one of the template's bigrams to another, as a window loses nothing by
shedding others at its ends. Runs where the texts are read; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.llm.common import text_slices

# Short public licence notices, by SPDX id.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_WORD = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def full_texts() -> tuple[tuple[str, str], ...]:
    """Whole licences and their file headers, by SPDX id (the file's name up to .header or .txt)."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return tuple((f.name.removesuffix(".txt").removesuffix(".header"), f.read_text("utf-8")) for f in files)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def bigrams(line: str) -> set[tuple[str, str]]:
    words = words_of(line)
    return set(zip(words, words[1:], strict=False))


class Templates:
    """Templates with their bigrams, which template has which bigram, and size bounds."""

    def __init__(self, templates: Sequence[tuple[str, str]], least: float):
        named = [(n, g) for n, text in templates if (g := bigrams(text))]
        self.least, self.names, self.sizes = least, [n for n, _ in named], [len(g) for _, g in named]
        ratio = least / (2 - least)
        # A match shares at least so many bigrams with its template, and has at most so many itself.
        self.needs = np.array([max(1, math.ceil(n * ratio - 1e-9)) for n in self.sizes], np.int64)
        self.most = [math.floor(n / ratio + 1e-9) for n in self.sizes]
        self.ids = {w: i for i, w in enumerate(sorted({w for _, g in named for x in g for w in x}))}
        code = {x: self.ids[x[0]] * len(self.ids) + self.ids[x[1]] for _, g in named for x in g}
        self.codes = np.array(sorted(code.values()), np.int64)
        self.has = np.zeros((len(self.codes) + 1, len(named)), bool)  # the last row is for bigrams of no template
        for k, (_, g) in enumerate(named):
            self.has[np.searchsorted(self.codes, [code[x] for x in g]), k] = True

    def match(self, text: str) -> list[tuple[str, float, int, int]]:
        """(name, Dice, first word, last word) of the passages of ``text``.

        Of each template's windows with Dice >= least the best is a passage (on ties the shortest, then the first), then the
        best of those that share no word with it, and so on.
        """
        words = words_of(text)
        if len(words) < 2 or not self.names:
            return []
        ids = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.ids) + ids[1:], -1)
        gram = np.searchsorted(self.codes, code)
        gram[self.codes[np.minimum(gram, len(self.codes) - 1)] != code] = len(self.codes)
        present = np.unique(gram)
        likely = np.flatnonzero(self.has[present].sum(0) >= self.needs)
        if not len(likely):
            return []
        number = {}
        own = np.fromiter((number.setdefault(x, len(number)) for x in zip(words, words[1:], strict=False)), np.int64, len(gram))
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        before, after = np.full(len(own), -1), np.full(len(own), len(own))
        before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
        return [(self.names[k], *p) for k in likely.tolist() for p in self._passages(k, self.has[gram, k], before, after)]

    def _best(self, k: int, i: int, limit: int, hit: np.ndarray, before: np.ndarray, upto: np.ndarray) -> tuple[float, int, int, int] | None:
        """(-Dice, words, first word, last word) of template k's best window from bigram i that ends before bigram ``limit``; none below ``least``."""
        size, need, most = self.sizes[k], int(self.needs[k]), self.most[k]
        width = 2 * most + 64
        if upto[limit] - upto[i] < need:
            return None
        while True:
            end = min(i + width, limit)
            new = before[i:end] < i
            own = np.cumsum(new)
            if end == limit or own[-1] > most:
                break
            width *= 2
        cut = int(np.searchsorted(own, most, "right"))
        new, own = new[:cut] & hit[i : i + cut], own[:cut]
        shared = np.cumsum(new)
        # A best window ends in a bigram of the template that is new in it.
        at = np.flatnonzero(new)[need - 1 :]
        if not len(at):
            return None
        dice = 2 * shared[at] / (own[at] + size)
        best = int(dice.argmax())
        return (-float(dice[best]), int(at[best]) + 1, i, i + int(at[best]) + 1) if dice[best] >= self.least else None

    def _passages(self, k: int, hit: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[float, int, int]]:
        """``hit``: bigrams of template k; ``before`` and ``after``: where each bigram stands last and next.

        Of each start only the best window is held. If a passage taken before is in its way, the start's best window up to that passage takes its place, which
        is no better; so the best of all is always on top.
        """
        upto = np.concatenate(([0], np.cumsum(hit)))
        # A window whose first or last bigram stands in it twice is no better than the one without it.
        starts = np.flatnonzero(hit)
        queue = [w for i in starts[upto[after[starts]] - upto[starts] >= self.needs[k]].tolist() if (w := self._best(k, i, int(after[i]), hit, before, upto))]
        heapq.heapify(queue)
        taken: list[tuple[int, int]] = []
        passages = []
        while queue:
            dice, _, first, last = heapq.heappop(queue)
            at = bisect.bisect_left(taken, (first, -1))
            if at and taken[at - 1][1] >= first:
                continue
            wall = taken[at][0] if at < len(taken) else len(hit) + 1
            if first >= wall:
                continue
            if last >= wall:
                # The last word of a window is the one after its last bigram.
                if (w := self._best(k, first, min(int(after[first]), wall - 1), hit, before, upto)) is not None:
                    heapq.heappush(queue, w)
                continue
            passages.append((-dice, first, last))
            bisect.insort(taken, (first, last))
        return passages


def scan_licences(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] | None = None,
    *,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, licences (sorted names), n_lines (lines with words of a passage), best (Dice or null).

    Templates are TEMPLATES and ``full_texts()`` unless given. A passage is a window of any length, in one line or over several, where
    twice the shared distinct word bigrams is at least ``least`` times the sum of both counts (``Templates.match`` says which
    of overlapping windows count). Words are runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII; lines end at newlines.

    Null and empty texts, and texts of under two words, match nothing: empty list, 0, null. A passage may
    match several templates; all are named. Repeated rows are scanned one by one. No documents or no
    templates give no rows or no matches. Other columns are ignored.
    """
    known = Templates((*TEMPLATES, *full_texts()) if templates is None else templates, least)

    def judged(text: str) -> tuple[list[str], int, float | None]:
        hits = known.match(text)
        if not hits:
            return [], 0, None
        counts = [len(words_of(line)) for line in text.split("\n")]
        line = np.repeat(np.arange(len(counts)), counts)
        on = {n for _, _, a, b in hits for n in np.unique(line[a : b + 1]).tolist()}
        return sorted({h[0] for h in hits}), len(on), max(h[1] for h in hits)

    kind = pa.struct([("licences", pa.list_(pa.string())), ("n_lines", pa.int64()), ("best", pa.float64())])

    @F.arrow_udf("struct<licences:array<string>,n_lines:long,best:double>")
    def look(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            rows = (judged((t or b"").decode("utf-8", "replace")) for part in text_slices(column) for t in part)
            yield pa.array([{"licences": names, "n_lines": n, "best": best} for names, n, best in rows], kind)

    found = docs.select(F.col(id_col).alias("doc_id"), look.asNondeterministic()(F.col(text_col)).alias("f"))
    return found.select("doc_id", "f.licences", "f.n_lines", "f.best")
