"""Linear-chain CRF: templates, scoring and Viterbi decoding.

A template is literal text with fields ``%x[row,col]``: feature ``col`` of the place ``row`` away.  Places outside the
sentence have marks of their own.  Templates that begin with ``u`` score a tag, those with ``b`` a pair of tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import few, gather

REACH = 5
#: Marks by distance before the first and behind the last place; the nearest ones have the other's sign.
BEFORE = ("_x+1", "_x-2", "_x-3", "_x-4", "_x-#")
BEHIND = ("_x-1", "_x+2", "_x+3", "_x+4", "_x+#")
_FIELD = re.compile(r"%x\[(-?\d+),(\d+)\]")


class BadTemplate(ValueError):
    """A template that can't be read."""


def parse_template(line: str) -> tuple:
    """Literals and ``(row, col)`` fields of a template in turn."""
    line = line.strip()
    if line[:1] not in ("u", "b"):
        raise BadTemplate(f"a template begins with u or b: {line!r}")
    parts, at = [], 0
    for m in _FIELD.finditer(line):
        row, col = int(m[1]), int(m[2])
        if abs(row) > REACH:
            raise BadTemplate(f"row beyond {REACH}: {line!r}")
        parts += [line[at : m.start()], (row, col)]
        at = m.end()
    parts.append(line[at:])
    if any("%" in p for p in parts if isinstance(p, str)):
        raise BadTemplate(f"bad field: {line!r}")
    return tuple(parts)


def expand(template: tuple, features: list, at: int) -> str:
    """The feature that a template gives at a place of a sentence; ``features`` has a sequence for each place."""
    out = []
    for p in template:
        if isinstance(p, str):
            out.append(p)
        else:
            i = at + p[0]
            out.append(BEFORE[-i - 1] if i < 0 else BEHIND[i - len(features)] if i >= len(features) else features[i][p[1]])
    return "".join(out)


def _shifted(places: Column, row: int, col: int) -> Column:
    """For each place the feature ``col`` of the place ``row`` away, marks where there is none."""
    own = F.transform(places, lambda p: F.get(p, F.lit(col)))
    if row < 0:
        return F.slice(F.concat(F.array(*map(F.lit, BEFORE[-row - 1 :: -1])), own), F.lit(1), F.size(places))
    return F.slice(F.concat(own, F.array(*map(F.lit, BEHIND[:row]))), F.lit(row + 1), F.size(places)) if row else own


def sentence_features(places: Column, templates: Iterable[str]) -> Column:
    """:func:`expand` of all templates at all places: an array for each place.  Linear in the sentence's length."""
    parsed = [parse_template(t) for t in templates]
    fields = sorted({p for t in parsed for p in t if not isinstance(p, str)})
    zipped = F.arrays_zip(F.transform(places, lambda p: F.lit(0)).alias("at"), *[_shifted(places, r, c).alias(f"f{k}") for k, (r, c) in enumerate(fields)])
    told = lambda z, t: F.concat(*[F.lit(p) if isinstance(p, str) else z[f"f{fields.index(p)}"] for p in t])
    return F.transform(zipped, lambda z: F.array(*[told(z, t) for t in parsed]))


def features(sents: DataFrame, places: str, templates: Iterable[str], keys: tuple) -> DataFrame:
    """``keys, idx, template, feature`` of each place of each sentence, whose feature arrays are in ``places``; no shuffle."""
    each = sents.filter(F.size(places) > 0).select(*keys, F.posexplode(sentence_features(F.col(places), templates)).alias("idx", "f"))
    return each.select(*keys, "idx", F.posexplode("f").alias("template", "feature"))


def unigram_scores(found: DataFrame, weights: DataFrame, keys: tuple) -> DataFrame:
    """``keys, idx, tag, score``: sums of the weights ``feature, tag, weight`` of known features.

    The weights are joined on the feature, of whatever size; few of them are broadcast, so that features of no weight
    aren't shuffled.
    """
    return found.join(few(weights), "feature").groupBy(*keys, "idx", "tag").agg(F.sum("weight").alias("score"))


@dataclass
class Crf:
    """Tags in byte order, templates, and weights as arrays by feature."""

    tags: list
    unigram_templates: list
    bigram_templates: list
    unigram: dict
    bigram: dict
    cache: dict = field(default_factory=dict, repr=False)

    @classmethod
    def build(cls, rows: list[tuple], templates: list[str]) -> Crf:
        """From rows ``feature, left, right, weight`` (``left`` counts only for ``b`` features) and template lines."""
        tags = sorted({r[2] for r in rows} | {r[1] for r in rows if r[0].startswith("b")}, key=str.encode)
        at = {t: i for i, t in enumerate(tags)}
        unigram: dict[str, np.ndarray] = {}
        bigram: dict[str, np.ndarray] = {}
        for feature, left, right, weight in rows:
            if feature.startswith("u"):
                unigram.setdefault(feature, np.zeros(len(tags)))[at[right]] = weight
            elif feature.startswith("b"):
                bigram.setdefault(feature, np.zeros((len(tags), len(tags))))[at[left], at[right]] = weight
            else:
                raise BadTemplate(f"a feature begins with u or b: {feature!r}")
        cut = [(t.strip()[:1], parse_template(t)) for t in templates if t.strip()]
        return cls(tags, [t for k, t in cut if k == "u"], [t for k, t in cut if k == "b"], unigram, bigram)

    @classmethod
    def load(cls, weights: DataFrame, templates: list[str]) -> Crf:
        return cls.build(gather(weights.select("feature", "left", "right", "weight")), templates)

    def scores(self, features: list, at: int) -> np.ndarray | float:
        """Score of each tag at a place."""
        out = 0.0
        for t in self.unigram_templates:
            own = self.unigram.get(expand(t, features, at))
            if own is not None:
                out = out + own
        return out

    def pairs(self, features: list, at: int) -> np.ndarray | float:
        out = 0.0
        for t in self.bigram_templates:
            own = self.bigram.get(expand(t, features, at))
            if own is not None:
                out = out + own
        return out

    def decode(self, features: list, begin: int, end: int, first: int | None = None, last: int | None = None, allowed: list | None = None, moves: np.ndarray | None = None) -> list[int]:
        """Best tags of the places from ``begin`` to ``end``, in the context of the whole sentence.

        ``first`` and ``last`` are the tags around the range, ``allowed`` the tags open to each place (None for all) and
        ``moves`` which tag may follow which; the step from ``first`` isn't held to it.  Of equal scores the tag that
        comes first stays.
        """
        n = len(self.tags)
        every = list(range(n))
        now = np.zeros(n)
        if first is not None:
            now = now + (self.pairs(features, begin)[first] if not np.isscalar(p := self.pairs(features, begin)) else p)
        now = now + self.scores(features, begin)
        open_ = every if allowed is None or allowed[begin] is None else allowed[begin]
        barred = None if moves is None else np.where(moves, 0.0, -1e37)
        back: list[np.ndarray] = []
        for at in range(begin + 1, end + (last is not None)):
            step = self.pairs(features, at)
            left = np.asarray(open_)
            table = now[left][:, None] + (step[left] if not np.isscalar(step) else np.full((len(left), n), step))
            if barred is not None:
                table = np.where(barred[left] < 0, -1e37, table)
            best = table.argmax(0)
            now = table[best, np.arange(n)]
            back.append(left[best])
            if at < end:
                now = now + self.scores(features, at)
                open_ = every if allowed is None or allowed[at] is None else allowed[at]
        if last is not None:
            tag = int(back.pop()[last])
        else:
            tag = max(open_, key=lambda y: (now[y], -open_.index(y)))
        out = [tag]
        for row in reversed(back):
            out.append(int(row[out[-1]]))
        return out[::-1]
