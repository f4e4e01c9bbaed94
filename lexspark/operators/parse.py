"""Dependency parsing by shift and arc actions: gold action sequences, greedy and beam parsers, training, scores.

A state has a stack, that begins with the root 0, and the words still to come.  ``shift`` moves the next word to the
stack.  A left arc makes the stack's top a child of the next word and drops it.  A right arc makes the next word a child
of the stack's top and puts the top back in its place.  A tree of n words takes n arcs and n shifts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import gather, ship
from .perceptron import Perceptron, mean_rows
from .segment import per_sentence

BEAM = 8
SHIFT, LEFT, RIGHT = "shift", "leftarc_", "rightarc_"
ROOT_LABELS = ("rightarc_ROOT", "rightarc_root")

#: Templates of the parser, in the notation that :func:`compile_templates` reads.
TEMPLATES = (
    "a:[STw]", "b:[STt]", "c:[N0w]", "d:[N0t]", "e:[N1w]", "f:[N1t]", "g:[N2t]", "h:[STw][STt]", "i:[N0w][N0t]", "j:[STt]/[N0t]", "k:[STw]/[N0w]", "l:[STt]/[N0t]/[N1t]",
    "m:[STPt]/[STt]/[N0t]", "n:[STt]/[STLCt]/[N0t]", "o:[STt]/[STRCt]/[N0t]", "p:[STt]/[N0t]/[N0LCt]", "q:[STt]/[N0t]/[N0RCt]", "r:[N0t]/[N1t]/[N2t]",
)
ATOMS = ("STw", "STt", "N0w", "N0t", "N1w", "N1t", "N2t", "STPt", "STLCt", "STRCt", "N0LCt", "N0RCt")


class BadTemplate(ValueError):
    """A parser template that names no known atom, or a bracket that never closes."""


def compile_templates(lines: Iterable[str]) -> list[tuple]:
    """Format string and atom numbers of each template; blank lines are left out."""
    out = []
    for line in map(str.strip, lines):
        if not line:
            continue
        if re.search(r"\[[^\]]*\Z", line):
            raise BadTemplate(f"missing ]: {line!r}")
        names = re.findall(r"\[([^\]]*)\]", line)
        unknown = [n for n in names if n not in ATOMS]
        if unknown:
            raise BadTemplate(f"unexpected feature {unknown[0]!r}: {line!r}")
        literal = re.split(r"\[[^\]]*\]", line)
        out.append(("%s".join(p.replace("%", "%%") for p in literal), tuple(ATOMS.index(n) for n in names)))
    return out


class State:
    """A partial parse.  Stack and words to come are linked pairs ``(node, rest)``, so a step costs the same however long
    the sentence is, and states share what they have in common.  A node is ``(id, leftmost child, rightmost child)``, -1
    where there is none; a node on the stack or to come has no head yet.
    """

    __slots__ = ("stack", "depth", "next", "left", "weight", "before", "action", "arc", "correct")

    def __init__(self, n: int = 0) -> None:
        self.stack, self.depth, self.next, self.left = ((0, -1, -1), None), 1, None, n
        for i in range(n, 0, -1):
            self.next = ((i, -1, -1), self.next)
        self.weight, self.before, self.action, self.arc, self.correct = 0.0, None, -1, None, True

    def done(self) -> bool:
        return not self.left and self.depth == 1

    def allows(self, kind: str, root: bool) -> bool:
        if not self.left:
            return False
        if kind == SHIFT:
            return self.left > 1 or not self.depth
        if not self.depth:
            return False
        return self.stack[0][0] != 0 if kind == LEFT else root == (self.depth == 1)

    def moved(self, kind: str, label: str, action: int = -1) -> State:
        """The state after an action; ``arc`` is the child, head and label that it added."""
        out = object.__new__(State)
        out.weight, out.before, out.action, out.correct = self.weight, self, action, self.correct
        word, rest = self.next
        if kind == SHIFT:
            out.stack, out.depth, out.next, out.left, out.arc = (word, self.stack), self.depth + 1, rest, self.left - 1, None
            return out
        top, below = self.stack
        child, head = (top, word) if kind == LEFT else (word, top)
        if child[0] < head[0]:
            grown = (head[0], child[0] if head[1] < 0 else min(child[0], head[1]), head[2])
        else:
            grown = (head[0], head[1], max(child[0], head[2]))
        out.stack, out.depth, out.next, out.left, out.arc = below, self.depth - 1, (grown, rest), self.left, (child[0], head[0], label)
        return out

    def tree(self, n: int) -> tuple[list[int], list[str]]:
        """Heads and labels of the words; -1 and ``NULL`` where there is no arc."""
        heads, labels, state = [-1] * n, ["NULL"] * n, self
        while state is not None:
            if state.arc:
                child, head, label = state.arc
                heads[child - 1], labels[child - 1] = head, label
            state = state.before
        return heads, labels

    def atoms(self, words: list[str], tags: list[str]) -> tuple:
        """Values of :data:`ATOMS`; ``words`` and ``tags`` have ROOT at 0."""
        sw = st = sl = sr = n0w = n0t = n0l = n0r = n1w = n1t = n2t = "NULL"
        if self.stack:
            i, a, b = self.stack[0]
            sw, st = words[i], tags[i]
            if a >= 0:
                sl = tags[a]
            if b >= 0:
                sr = tags[b]
        if self.next:
            (i, a, b), rest = self.next
            n0w, n0t = words[i], tags[i]
            if a >= 0:
                n0l = tags[a]
            if b >= 0:
                n0r = tags[b]
            if rest:
                (i, _, _), rest = rest
                n1w, n1t = words[i], tags[i]
                if rest:
                    n2t = tags[rest[0][0]]
        return sw, st, n0w, n0t, n1w, n1t, n2t, "NULL", sl, sr, n0l, n0r


def gold_actions(heads: list[int], labels: list[str]) -> list[str]:
    """Actions that build a tree; ``heads`` count words from 1, 0 is the root.

    A tree that arcs can't build (crossing arcs) leaves words on the stack, each told as ``reduce``.
    """
    n = len(heads)
    head = [-1, *heads]
    stack, following, out = [0], list(range(n, 0, -1)), []
    while following or len(stack) > 1:
        if not following:
            stack.pop()
            out.append("reduce")
            continue
        word = following[-1]
        if stack and head[stack[-1]] == word:
            out.append(LEFT + labels[stack.pop() - 1])
        elif stack and head[word] == stack[-1] and not any(head[i] == word for i in following):
            out.append(RIGHT + labels[word - 1])
            following[-1] = stack.pop()
        else:
            stack.append(following.pop())
            out.append(SHIFT)
    return out


def split_action(action: str) -> tuple[str, str]:
    """Kind and label of an action."""
    for kind in (LEFT, RIGHT):
        if action.startswith(kind[:-1]):
            return kind, action[len(kind) :]
    if action == SHIFT:
        return SHIFT, ""
    raise ValueError(f"unexpected action {action!r}")


class Parser:
    def __init__(self, model: Perceptron, templates: Iterable[str] = TEMPLATES, beam: int = BEAM) -> None:
        self.model, self.beam, self.templates = model, beam, compile_templates(templates)
        self.actions = [split_action(y) for y in model.labels]
        self.groups: dict[tuple[str, bool], list[int]] = {}
        for y, name in enumerate(model.labels):
            self.groups.setdefault((self.actions[y][0], name in ROOT_LABELS), []).append(y)

    def features(self, state: State, words: list[str], tags: list[str]) -> list[str]:
        atoms = state.atoms(words, tags)
        return [text % tuple([atoms[i] for i in at]) for text, at in self.templates]

    def allowed(self, state: State) -> list[int]:
        """Actions that the state allows, by groups that share their preconditions."""
        if not state.left:
            return []
        out = []
        for (kind, root), ys in self.groups.items():
            if state.allows(kind, root):
                out += ys
        return out

    def greedy(self, words: list[str], tags: list[str]) -> tuple[list[int], list[str]]:
        """Heads and labels by the best allowed action each time, the first of equals."""
        words, tags = ["ROOT", *words], ["ROOT", *tags]
        state = State(len(words) - 1)
        while not state.done():
            options = self.allowed(state)
            if not options:
                raise ValueError("no action is allowed: the model lacks shift, or a root arc")
            scores = self.model.scores(self.features(state, words, tags))
            state = state.moved(*self.actions[max(options, key=lambda y: (scores[y], -y))])
        return state.tree(len(words) - 1)

    def step(self, states: list[State], words: list[str], tags: list[str]) -> list[State]:
        """The best successors of all states, best first; of equals those of earlier states and labels."""
        options = []
        for i, state in enumerate(states):
            allowed = self.allowed(state)
            if allowed:
                scores = self.model.scores(self.features(state, words, tags))
                options += [(-(state.weight + scores[y]), i, y) for y in allowed]
        out = []
        for weight, i, y in heapq.nsmallest(self.beam, options):
            out.append(states[i].moved(*self.actions[y], y))
            out[-1].weight = -weight
        return out

    def search(self, words: list[str], tags: list[str]) -> tuple[list[int], list[str]]:
        """Heads and labels by beam search."""
        words, tags = ["ROOT", *words], ["ROOT", *tags]
        states = [State(len(words) - 1)]
        while following := self.step(states, words, tags):
            states = following
        best = max(states, key=lambda s: s.weight)
        return best.tree(len(words) - 1)


def _learn(parser: Parser, wrong: State, right: State, words: list[str], tags: list[str]) -> None:
    while not wrong.correct:
        good, bad = right.action, wrong.action
        wrong, right = wrong.before, right.before
        parser.model.update(parser.features(right, words, tags), good, 1.0)
        parser.model.update(parser.features(wrong, words, tags), bad, -1.0)


def train_rows(trees: list[tuple], templates: Iterable[str] = TEMPLATES, beam: int = BEAM, iterations: int = 10) -> list[tuple[str, str, float]]:
    """Averaged weights ``feature, label, weight`` of a structured perceptron.

    ``trees`` has words, tags, heads and labels of each sentence.  Where no state of the beam is right any more, weights
    are moved along the actions since the last common one, and the search goes on from the right state alone.
    """
    gold = [gold_actions(h, y) for _, _, h, y in trees]
    if any("reduce" in g for g in gold):
        raise ValueError("a tree with crossing arcs can't be learned")
    parser = Parser(Perceptron({a for g in gold for a in g}), templates, beam)
    model = parser.model
    for _ in range(iterations):
        for (words, tags, _, _), actions in zip(trees, gold):
            words, tags = ["ROOT", *words], ["ROOT", *tags]
            states = [State(len(words) - 1)]
            right = State(len(words) - 1)
            for action in actions:
                y = model.at[action]
                right = right.moved(*parser.actions[y], y)
                states = parser.step(states, words, tags) or states
                for s in states:
                    s.correct = s.action == y and s.before is not None and s.before.correct
                model.samples += 1
                if not any(s.correct for s in states):
                    _learn(parser, max(states, key=lambda s: s.weight), right, words, tags)
                    states = [right]
            best = max(states, key=lambda s: s.weight)
            if not best.correct:
                _learn(parser, best, right, words, tags)
    model.average()
    return model.rows()


def train(trees: DataFrame, templates: Iterable[str] = TEMPLATES, beam: int = BEAM, iterations: int = 10, shards: int = 1) -> list[tuple[str, str, float]]:
    """:func:`train_rows` on a table ``sent, words, tags, heads, labels``.

    The perceptron learns in order of ``sent``.  With several shards each learns by itself on a worker and the mean of
    their weights is taken, so no machine holds all trees.
    """
    templates = tuple(templates)

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("sent")
        rows = train_rows([(list(r.words), list(r.tags), [int(h) for h in r.heads], list(r.labels)) for r in pdf.itertuples()], templates, beam, iterations)
        return pd.DataFrame(rows, columns=["feature", "label", "weight"]).assign(shard=pdf["shard"].iloc[0])

    cut = trees.withColumn("shard", F.pmod(F.xxhash64("sent"), F.lit(shards)))
    models: dict[int, list] = {}
    for feature, label, weight, shard in gather(cut.groupBy("shard").applyInPandas(one, "feature string, label string, weight double, shard bigint")):
        models.setdefault(shard, []).append((feature, label, weight))
    return mean_rows(list(models.values())) if models else []


_TREE = pa.struct([("heads", pa.list_(pa.int32())), ("labels", pa.list_(pa.string()))])


def _split_tagged(column: pa.StructArray) -> Iterator[tuple[list[str], list[str]]]:
    for row in column.to_pylist():
        yield row["w"] or [], row["t"] or []


def parse(tagged: DataFrame, method: str, model: Perceptron | None = None, templates: Iterable[str] = TEMPLATES, beam: int = BEAM) -> DataFrame:
    """``tagged`` with ``tree``, its ``heads`` (from 1, 0 is the root) and ``labels``.  ``method``: greedy, beam or none."""
    if method == "none":
        return tagged.withColumn("tree", F.struct(F.transform("words", lambda w: F.lit(0)).alias("heads"), F.transform("words", lambda w: F.lit("none")).alias("labels")))
    if method not in ("greedy", "beam") or model is None:
        raise ValueError(f"no parser {method!r}" if method not in ("greedy", "beam") else "the parser needs a model")
    shared = ship(tagged.sparkSession, (model, tuple(templates), beam))

    def decode():
        parser = Parser(*shared())
        run = parser.greedy if method == "greedy" else parser.search
        return lambda words, tags: dict(zip(("heads", "labels"), run(words, tags)))

    doubled = tagged.withColumn("__s", F.struct(F.col("words.word").alias("w"), F.col("tags").alias("t")))
    return per_sentence(doubled, decode, "tree", "struct<heads:array<int>,labels:array<string>>", _TREE, "__s", _split_tagged)


def attachment_scores(pairs: DataFrame) -> DataFrame:
    """``total, uas, las`` of rows ``tag, gold_head, gold_label, head, label``; punctuation (PU, and tags in w) is left out."""
    kept = pairs.filter((F.col("tag") != "PU") & ~F.col("tag").startswith("w"))
    head = F.col("gold_head") == F.col("head")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 9)
    return kept.agg(F.count("*").alias("total"), share(head).alias("uas"), share(head & (F.col("gold_label") == F.col("label"))).alias("las"))


def evaluate(trees: DataFrame, method: str, model: Perceptron, templates: Iterable[str] = TEMPLATES, beam: int = BEAM) -> DataFrame:
    """``total, uas, las`` of a parser on ``words, tags, heads, labels`` of sentences, with the tags that are given."""
    gold = trees.select(F.transform("words", lambda w: F.struct(w.alias("word"))).alias("words"), "tags", F.col("heads").alias("__heads"), F.col("labels").alias("__labels"))
    done = parse(gold, method, model, templates, beam)
    zipped = F.arrays_zip(F.col("tags").alias("tag"), F.col("__heads").alias("gold_head"), F.col("__labels").alias("gold_label"), F.col("tree.heads").alias("head"), F.col("tree.labels").alias("label"))
    return attachment_scores(done.select(F.explode(zipped).alias("z")).select("z.*"))


def oracle(trees: DataFrame) -> DataFrame:
    """``sent, step, action`` of a table ``sent, heads, labels``."""
    rows = trees.select("sent", F.struct(F.col("heads").alias("w"), F.col("labels").alias("t")).alias("tree"))
    done = per_sentence(rows, lambda: gold_actions, "actions", "array<string>", pa.list_(pa.string()), "tree", _split_tagged)
    return done.select("sent", F.posexplode("actions").alias("step", "action"))
