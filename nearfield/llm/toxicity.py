"""Toxicity from a learned lexicon, matched through Levenshtein automata, scored in context.

The lexicon is learned from labelled texts: words, and the stems at which words part, which occur in toxic texts and
hardly in others, as far as chance allows for a sample of that size. Every text of the sample counts by how new it is: a
run of words that k texts had before counts 1 / (k + 1), and the mean over its runs is a text's weight. So many copies of
a text are worth little more than a few, and none is left out. Its entries form a trie. A word is read by the product of
the trie with Levenshtein automata, made deterministic as words need it, so that a word costs one table look-up a
character and most words fall out of the table at once. Words of four letters or more may be matched with one edit, of
eight or more with two; a swap of neighbours is one edit. What a match with edits is worth is learned as well.

A match is weighed by its window of words: other matches nearby raise it, a quotation that it lies in, of any length, or
words of reporting near it lower it. Features of the matches of the whole text go through a logistic function.

Defined results: a null text counts as empty; texts without a match, empty ones too, get the score of no evidence.
Without labels of both kinds every score is the share of toxic labels (0.0 without any). Repeated rows get equal scores.
Only doc_id and text are read for a score, so that other columns, whatever their names, don't matter; an empty table gives
an empty result. The tables of the automaton are dropped and made anew beyond MAX_HELD members.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .learning import remainder, sample_labelled

THRESHOLD = 0.3
TOXIC_SAMPLE = 1200
CLEAN_SAMPLE = 2400
#: Shortest stem, shortest words that may be matched with one edit and with two, and shortest stem with one.
MIN_STEM = 4
FUZZY_FROM = 4
FUZZY_TWICE = 8
FUZZY_STEM = 5
#: Words on either side that make up the context of a match.
CONTEXT = 6
#: Members of the automaton's states that a worker holds.
MAX_HELD = 1_000_000
WORD = re.compile(r"[^\W_](?:[^\W_]|['’*@$!](?=[^\W_]))*")
#: Opening quotation marks and what closes them; a mark that closes one opens another where none is open.
CLOSING = {'"': '"', "`": "`", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "‚": "‘’"}
QUOTE = re.compile("[\"`“”„«»‹›‘’‚]")
#: Words that report another's words.
REPORTING = frozenset("said says wrote quote quoted called calls word term dit écrit mot citation sagte schrieb wort zitat dijo escribió palabra cita".split())


class LexiconAutomaton:
    """Words and stems as a trie, crossed with Levenshtein automata that know swaps of neighbours.

    A state is a set of (trie node, edits so far, character that a begun swap waits for) with the fewest edits each.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.terms = [*words, *stems]
        self.n_words = len(words)
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.bound = [0]  # the most edits that any term below a node may have
        for k, term in enumerate(self.terms):
            node, path = 0, [0]
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.bound.append(0)
                node = nxt
                path.append(node)
            (self.word_at if k < len(words) else self.stem_at)[node] = k
            for x in path:
                self.bound[x] = max(self.bound[x], self.edits(k))
        self._reset()

    def edits(self, k: int) -> int:
        """Edits that term ``k`` may be matched with."""
        n = len(self.terms[k])
        if k >= self.n_words:
            return int(n >= FUZZY_STEM)
        return int(n >= FUZZY_FROM) + int(n >= FUZZY_TWICE)

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.held = 0
        self.start = self._state({(0, 0, "")})

    def _state(self, found: set[tuple[int, int, str]]) -> int:
        """The number of the state of ``found`` and all that missing characters lead to; -1 for none."""
        least: dict[tuple[int, str], int] = {}
        todo = list(found)
        while todo:
            node, e, wait = todo.pop()
            if least.get((node, wait), 9) <= e:
                continue
            least[node, wait] = e
            if not wait:
                todo += [(x, e + 1, "") for x in self.children[node].values() if e < self.bound[x]]
        if not least:
            return -1
        key = frozenset(least.items())
        if (got := self.ids.get(key)) is not None:
            return got
        self.ids[key] = k = len(self.sets)
        self.sets.append(key)
        self.held += len(key)
        self.moves.append({})
        ok = lambda at: min(((e, at[n]) for (n, wait), e in key if not wait and n in at and e <= self.edits(at[n])), default=None)
        self.ends.append(ok(self.word_at))
        self.stems.append(ok(self.stem_at))
        return k

    def _step(self, state: int, c: str) -> int:
        out = set()
        for (node, wait), e in self.sets[state]:
            if wait:
                if wait == c:
                    out.add((node, e, ""))
                continue
            for x, child in self.children[node].items():
                if x == c:
                    out.add((child, e, ""))
                elif e < self.bound[child]:
                    out.add((child, e + 1, ""))  # another character
                    if (swapped := self.children[child].get(c)) is not None and e < self.bound[swapped]:
                        out.add((swapped, e + 1, x))
            if e < self.bound[node]:
                out.add((node, e + 1, ""))  # a character too many
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best match of a word, or None."""
        if self.held > MAX_HELD:
            self._reset()
        state, best, moves = self.start, None, self.moves
        for c in word:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = moves[state][c] = self._step(state, c)
            if nxt < 0:
                return best
            state = nxt
            s = self.stems[state]
            if s is not None and (best is None or s < best):
                best = s
                if s[0] == 0:
                    return best
        e = self.ends[state]
        return e if e is not None and (best is None or e <= best) else best


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of the quotations of a text, outer ones only, in order. A mark that is never closed opens none."""
    opened: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in QUOTE.finditer(text):
        c, at = m.group(), m.start()
        word_before, word_after = text[at - 1 : at].isalnum(), text[at + 1 : at + 2].isalnum()
        k = next((k for k in range(len(opened) - 1, -1, -1) if c in CLOSING[opened[k][0]]), None)
        if k is not None and not word_after and not (c == "’" and text[at - 1 : at].isspace()):
            spans.append((opened[k][1], at))
            del opened[k:]
        elif c in CLOSING and not word_before:
            same = next((j for j, (o, _) in enumerate(opened) if o == c), None)
            if same is None:
                opened.append((c, at))
            elif c in CLOSING[c] or not text[:at].rstrip(" ").endswith("\n"):  # a mark at the start of a paragraph goes on with the quotation
                del opened[same:]
                opened.append((c, at))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a > out[-1][1]:
            out.append((a, b))
        else:
            out[-1] = out[-1][0], max(b, out[-1][1])
    return out


@dataclass
class ToxicityModel:
    automaton: LexiconAutomaton | None
    worth: dict[tuple[int, int], float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    constant: float = 0.0
    memo: dict[str, tuple[int, int] | None] = field(default_factory=dict)

    def find(self, word: str) -> tuple[int, int] | None:
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = got = self.automaton.match(word)
        return got

    def features(self, text: str) -> np.ndarray | None:
        """None without a match; else what the matches of the whole text come to."""
        low = text.lower()
        hits = []
        place = 0
        before: deque[str] = deque(maxlen=CONTEXT)
        find, memo = self.find, self.memo
        for m in WORD.finditer(low):
            w = m.group()
            got = memo[w] if w in memo else find(w)
            if got is not None:
                hits.append((place, m.start(), m.end(), got, not REPORTING.isdisjoint(before)))
            before.append(w)
            place += 1
        if not hits:
            return None
        strengths, quoted = [], 0
        spans = quotations(low)
        for k, (at, start, end, (edits, term), reported) in enumerate(hits):
            worth = self.worth.get((edits, term), 0.0)
            near = (k and at - hits[k - 1][0] <= CONTEXT) + (k + 1 < len(hits) and hits[k + 1][0] - at <= CONTEXT)
            k_span = bisect_right(spans, (start, len(low))) - 1
            inside = k_span >= 0 and end <= spans[k_span][1]
            told = inside or reported
            quoted += told
            strengths.append(worth * (0.4 if told else 1.0) + 0.5 * near * (worth > 0))
        best = sorted(strengths, reverse=True)
        return np.array([1.0, best[0], sum(best[:3]) / 3, math.log1p(sum(s > 1 for s in best)), math.log1p(1000 * len(hits) / (place + 20)), quoted / len(hits)])

    def score(self, text: str | None) -> float:
        if self.automaton is None:
            return self.constant
        x = self.features(text or "")
        if x is None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def novelty(texts: list[str], run: int = 3) -> list[float]:
    """A weight for each text: the mean over its runs of words of 1 / (1 + how many texts had the run before).

    A word of one text that was copied often would else look like a word of many texts.
    """
    seen: Counter = Counter()
    out = []
    for t in texts:
        words = WORD.findall(t.lower())
        runs = {tuple(words[i : i + run]) for i in range(max(1, len(words) - run + 1))}
        out.append(sum(1 / (1 + seen[r]) for r in runs) / len(runs))
        seen.update(runs)
    return out


def partings(words: set[str]) -> set[str]:
    """The prefixes of MIN_STEM letters or more at which words part, or one word ends and another goes on."""
    ordered = sorted(words)
    shared = (os.path.commonprefix(pair) for pair in zip(ordered, ordered[1:], strict=False))
    return {p for p in shared if len(p) >= MIN_STEM}


def candidates(text: str, stems: set[str], lengths: list[int]) -> set[str]:
    """Words, marked by a blank at their end, and those of ``stems``, which have the given lengths, that begin one."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) >= 3:
            out.add(w + " ")
            for n in lengths:
                if n > len(w):
                    break
                if w[:n] in stems:
                    out.add(w[:n])
    return out


def learn_lexicon(toxic: list[tuple[str, float]], clean: list[tuple[str, float]]) -> list[str]:
    """Words (marked by a blank) and stems that tell toxic texts, the most frequent first, from texts with their weights.

    A candidate must occur in toxic texts of enough weight that chance would give less than one such candidate in all,
    and in hardly any clean text. Of candidates that occur in the same texts the longest is taken, and none that goes on
    from a stem that is taken.
    """
    stems = partings({w for t, _ in toxic for w in WORD.findall(t.lower()) if len(w) >= 3})
    lengths = sorted({len(x) for x in stems})
    bad: dict[str, float] = defaultdict(float)
    good: dict[str, float] = defaultdict(float)
    for t, weight in toxic:
        for c in candidates(t, stems, lengths):
            bad[c] += weight
    for t, weight in clean:
        for c in candidates(t, stems, lengths):
            if c in bad:
                good[c] += weight
    n_toxic, n_clean = sum(x for _, x in toxic), sum(x for _, x in clean)
    share = n_toxic / (n_toxic + n_clean)
    pure = [c for c, n in bad.items() if n >= 3 and good[c] * n_toxic <= 0.02 * n * n_clean]
    counts = sorted(bad[c] + good[c] for c in bad)
    least = next((n for n in range(3, int(n_toxic) + 3) if (len(counts) - bisect_left(counts, n)) * share**n < 0.2), 3)
    taken: list[str] = []
    stems_taken: set[str] = set()
    longer: dict[str, float] = defaultdict(float)  # the weight of the heaviest taken entry that begins so
    for c in sorted((c for c in pure if bad[c] >= least), key=lambda c: (-bad[c], good[c], -len(c), c)):
        stem = c.rstrip()
        if any(stem[:n] in stems_taken for n in lengths) or longer[stem] >= 0.9 * bad[c]:
            continue
        taken.append(c)
        if stem == c:
            stems_taken.add(c)
        for n in range(1, len(stem) + 1):
            longer[stem[:n]] = max(longer[stem[:n]], bad[c])
    return taken


def fit(rows: list[tuple[str, int]], share: float) -> ToxicityModel:
    """A model from labelled texts; ``share`` is the share of toxic texts where the model will be used."""
    toxic, clean = ([t for t, y in rows if y == label] for label in (1, 0))
    toxic, clean = list(zip(toxic, novelty(toxic), strict=True)), list(zip(clean, novelty(clean), strict=True))
    terms = learn_lexicon(toxic, clean) if toxic and clean else []
    if not terms:
        return ToxicityModel(None, constant=share)
    words, stems = [t[:-1] for t in terms if t.endswith(" ")], [t for t in terms if not t.endswith(" ")]
    model = ToxicityModel(LexiconAutomaton(words, stems))
    n_toxic, n_clean = sum(x for _, x in toxic), sum(x for _, x in clean)
    seen: dict[tuple, float] = defaultdict(float)
    for texts, y in ((toxic, 1), (clean, 0)):
        for t, weight in texts:
            for hit in {model.find(w) for w in set(WORD.findall(t.lower()))} - {None}:
                seen[hit, y] += weight
    for k, term in enumerate(model.automaton.terms):
        for edits in range(model.automaton.edits(k) + 1):
            # log odds of the match, smoothed: edits of a long whole word are taken as a misspelling until texts say otherwise
            prior = (2.0, 0.5) if edits == 0 else (0.6, 0.3) if k < len(words) and len(term) >= 6 * edits else (0.2, 0.4)
            p = (seen[(edits, k), 1] + prior[0]) / (n_toxic + 2)
            n = (seen[(edits, k), 0] + prior[1]) / (n_clean + 2)
            base = math.log((n_clean + 2) / (n_toxic + 2)) if not seen[(edits, k), 1] + seen[(edits, k), 0] else 0.0
            model.worth[edits, k] = min(5.0, max(-1.0, math.log(p / n) - base))
    found = [(model.features(t), y, weight) for texts, y in ((toxic, 1), (clean, 0)) for t, weight in texts]
    rate_toxic = sum(w for f, y, w in found if f is None and y) / n_toxic * share
    rate_clean = sum(w for f, y, w in found if f is None and not y) / n_clean * (1 - share)
    model.constant = min(0.2, rate_toxic / max(rate_toxic + rate_clean, 1e-9))
    f, y, own = (np.array(x, float) for x in zip(*((f, y, w) for f, y, w in found if f is not None), strict=True))
    weight = own * np.where(y == 1, share / n_toxic, (1 - share) / n_clean)
    weight *= len(y) / weight.sum()
    prior = np.array([-2.5, 1.0, 0.3, 0.5, 0.0, -0.5])
    w = prior.copy()
    for _ in range(60):  # Newton's method, drawn to the prior
        q = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (weight * (q - y)) + 0.5 * (w - prior)
        hess = (f * (weight * q * (1 - q))[:, None]).T @ f + 0.5 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    model.weights = w
    model.memo.clear()
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    r = remainder(F.col("doc_id"), 4)
    seen = labels.filter((r >= 0) & (r != 2) & F.col(label).isNotNull())
    total, ones = seen.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    rows = sample_labelled(documents, seen, label, {1: TOXIC_SAMPLE, 0: CLEAN_SAMPLE})
    return fit(rows, (ones or 0) / total if total else 0.0)


def score(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ship(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([shipped.value.score(t.as_py()) for t in b.column("text")], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), "text", (remainder(F.col("doc_id"), 4) == 2).alias("held_out")).mapInArrow(run, SCHEMA)
