"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon (whole words, and stems of STEM characters that words begin with) is learned
from labelled training rows. Its trie, intersected with the Levenshtein automaton of
distance one, is determinised into one transition table; distinct words of a slice of
texts run through that table together, a character at a time. A word at distance one of a
term counts as misspelled where the term is long enough and the word is none that clean
training texts hold. Each hit is then weighed by its window of words: between
quotation marks or behind a verb of reporting it counts as quotation, else as abuse. A
logistic model over these counts gives the score; abuse can only raise it, and a
quotation alone cannot. Its weights are fitted on training rows and on copies of them
with misspelled terms (toxic) and with quoted terms (clean), so both are observed.

Only text is an input of the score. Labels of held-out rows (crc32 of the id as text
leaves 2 modulo 4) are never read for fitting.

Defined cases: null and empty texts have no hits and get the model's base score;
without usable labels a fixed prior model with an empty lexicon is used; very long texts
and words are read whole; repeated rows and ids are judged alone; a label given twice for
an id counts as the larger; of terms that match a word equally well the first in the
lexicon counts; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.runtime import ship

from .common import annotate, give_back, labelled_sample, per_text, slices

WORD = re.compile(r"\w+")
WINDOW = 6
#: Signs and verbs that mark a quotation.
QUOTES = "\"“”„«»‘’"
REPORTS = frozenset("said says say called calls quote quoted quotes wrote word words term insult sagte sagt zitat wort nannte dit mot appelé citation dijo palabra llamó cita".split())

NONE, EXACT, FUZZY = 0, 1, 2
#: Characters of stems in the lexicon; least characters of terms whose misspellings count.
STEM = (3, 12)
FUZZY_WORD, FUZZY_STEM = 4, 8
#: Log-odds from which single hits of a term count. Terms that clean texts hold too count by their share of a text's words.
STRONG = 4.0


class Automaton:
    """The product of a lexicon trie and the Levenshtein automaton of distance one, made deterministic.

    terms: (text, beginning): beginning accepts any word that starts so.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.longest = max((len(t) for t, _ in terms), default=0) + 2
        kids: list[dict[str, int]] = [{}]
        whole: list[int] = [-1]
        start: list[int] = [-1]
        for i, (t, beginning) in enumerate(terms):
            at = 0
            for c in t:
                if c not in kids[at]:
                    kids[at][c] = len(kids)
                    kids.append({})
                    whole.append(-1)
                    start.append(-1)
                at = kids[at][c]
            (start if beginning else whole)[at] = i
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted({c for t, _ in terms for c in t}))}
        n_class = len(self.alphabet) + 2  # 0: another character, last: end of word
        end = n_class - 1

        def closed(states):
            """Deletions from the word: a node at distance 0 also reaches its children at distance 1."""
            out = set(states)
            for node, e in states:
                if e == 0:
                    out.update((k, 1) for k in kids[node].values())
            return out

        # A state: (trie states, best hit so far as (kind, term)); kinds order exact before fuzzy.
        def begin(states, hit):
            for node, e in states:
                if start[node] >= 0 and len(terms[start[node]][0]) - e >= STEM[0]:
                    kind = EXACT if e == 0 else FUZZY
                    if hit[0] == NONE or kind < hit[0] or (kind == hit[0] and start[node] < hit[1]):
                        hit = (kind, start[node])
            return hit

        first = frozenset(closed({(0, 0)}))
        ids = {(first, (NONE, -1)): 0}
        todo, table, self.hit = [(first, (NONE, -1))], [], []
        while todo:
            state = todo.pop(0)
            states, hit = state
            row = np.zeros(n_class, dtype=np.int32)
            table.append(row)
            self.hit.append(hit)
            for c, k in [("", 0), *self.alphabet.items(), (None, end)]:
                if c is None:  # end of word: whole terms are accepted now
                    best = hit
                    for node, e in states:
                        if whole[node] >= 0:
                            kind = EXACT if e == 0 else FUZZY
                            if best[0] == NONE or kind < best[0] or (kind == best[0] and whole[node] < best[1]):
                                best = (kind, whole[node])
                    nxt = (frozenset(), best)
                elif hit[0] == EXACT:
                    nxt = (frozenset(), hit)
                else:
                    moved = set()
                    for node, e in states:
                        if c and c in kids[node]:
                            moved.add((kids[node][c], e))
                        if e == 0:
                            moved.add((node, 1))  # a character too many
                            moved.update((x, 1) for x in kids[node].values())  # another character
                    moved = closed(moved)
                    moved = {(x, e) for x, e in moved if not (e == 1 and (x, 0) in moved)}
                    h = begin(moved, hit)
                    nxt = (frozenset(moved) if h[0] != EXACT else frozenset(), h)
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row[k] = ids[nxt]
        self.table = np.array(table)
        self.kind = np.array([h[0] for h in self.hit], dtype=np.int8)
        self.term = np.array([h[1] for h in self.hit], dtype=np.int32)
        self.end = end
        self.classes = np.zeros(0x110000, dtype=np.uint8 if n_class < 250 else np.uint16)
        for c, k in self.alphabet.items():
            self.classes[ord(c)] = k

    def match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Hits of distinct words: word to (kind, term)."""
        if not self.terms or not words:
            return {}
        wide = self.longest + 1
        m = np.array([w[:wide].replace("\0", " ") for w in words], dtype=f"U{wide}").view(np.uint32).reshape(len(words), wide)
        size = np.minimum([len(w) for w in words], wide)
        state = np.zeros(len(words), dtype=np.int32)
        for k in range(wide):
            # Past its end a word stays in the state that the end led to; long words never reach theirs.
            step = self.table[state, np.where(k < size, self.classes[m[:, k]], self.end)]
            state = np.where(k <= size, step, state)
        hits = np.nonzero(self.kind[state])[0]
        return {words[i]: (int(self.kind[state[i]]), int(self.term[state[i]])) for i in hits.tolist()}


def quoted(text: str, spans: list[tuple[int, int]], i: int) -> bool:
    """Whether the i-th word's window shows a quotation."""
    lo, hi = max(0, i - WINDOW), min(len(spans) - 1, i + WINDOW)
    before, after = text[spans[lo][0] : spans[i][0]], text[spans[i][1] : spans[hi][1] + 2]
    opened = sum(before.count(c) for c in QUOTES) % 2 == 1
    closes = any(c in after for c in QUOTES)
    return opened and closes or any(text[a:b].lower() in REPORTS for a, b in spans[lo:i])


class Reader:
    """Hits of texts: features for the logistic model, and plain counts of the last call.

    common: words that are near a term but usual in clean texts, so no misspellings.
    """

    def __init__(self, lexicon: list[tuple[str, bool, float]], common: list[str] | frozenset[str] = frozenset()):
        self.auto = Automaton([(t, b) for t, b, _ in lexicon])
        self.weight = [w for _, _, w in lexicon]
        self.may_miss = [len(t) >= (FUZZY_STEM if b else FUZZY_WORD) for t, b, _ in lexicon]
        self.common = frozenset(common)
        self.hits: dict[str, tuple[int, int]] = {}
        self.seen: set[str] = set()

    def look_up(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """Words that the automaton accepts, as (kind, term)."""
        new = words.difference(self.seen)
        if len(self.seen) + len(new) > 150_000:
            self.seen, self.hits = set(), {}
            new = words
        found = self.auto.match(list(new))
        self.hits.update({w: h for w, h in found.items() if h[0] == EXACT or (self.may_miss[h[1]] and len(w) >= FUZZY_WORD and w not in self.common)})
        self.seen |= new
        return self.hits

    def features(self, texts: list[str]) -> np.ndarray:
        lists = [list(map(str.lower, WORD.findall(t))) for t in texts]
        hits = self.look_up(set(chain.from_iterable(lists)))
        out = np.zeros((len(texts), 7))
        self.counts = np.zeros((len(texts), 4), dtype=np.int64)
        for d, words in enumerate(lists):
            at = [i for i, w in enumerate(words) if w in hits]
            if not at:
                continue
            spans = [m.span() for m in WORD.finditer(texts[d])]
            row, n = [0] * 4, [0] * 4
            top, weak = 0.0, 0
            for i in at:
                kind, term = hits[words[i]]
                q = quoted(texts[d], spans, i)
                n[2 * (kind == FUZZY) + q] += 1
                if self.weight[term] < STRONG:
                    weak += not q
                    continue
                row[2 * (kind == FUZZY) + q] += 1
                if not q:
                    top = max(top, self.weight[term] * (1.0 if kind == EXACT else 0.9))
            out[d, :4] = np.log1p(row)
            out[d, 4] = top
            out[d, 5] = min(1.0, 10.0 * (row[0] + row[2]) / len(words))
            out[d, 6] = min(3.0, 100.0 * weak / len(words))
            self.counts[d] = n
        return out


#: Model without labels: no lexicon, low base score.
PRIOR = {"lexicon": [], "common": [], "weights": [-3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]}


def learn_lexicon(texts: list[str], toxic: np.ndarray, purity: float = 0.9, depth: int = 4) -> list[tuple[str, bool, float]]:
    """Greedy cover of toxic texts, each by up to `depth` terms: whole words and stems that clean texts hardly have.

    A term's excess in toxic texts has to be beyond chance among all terms seen (log-likelihood
    ratio). Terms that begin with a chosen one, or the other way round, are passed over.
    purity: least share of toxic texts, at equal class sizes, among those that hold the term.
    """
    have: list[set[tuple[str, bool]]] = []
    pos: Counter = Counter()
    neg: Counter = Counter()
    low, high = STEM
    for t, y in zip(texts, toxic, strict=True):
        words = set(map(str.lower, WORD.findall(t)))
        terms = {(w, False) for w in words if len(w) >= low}
        terms |= {(w[:k], True) for w in words for k in range(low, min(len(w), high + 1))}
        (pos if y else neg).update(terms)
        have.append(terms if y else set())
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    share = n_pos / (n_pos + n_neg)
    chance = 2 * math.log(max(2, len(pos) + len(neg.keys() - pos.keys()))) + 3
    score = {}
    for term, a in pos.items():
        b = neg[term]
        ra, rb = a / n_pos, (b + 0.5) / n_neg
        ratio = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if a >= 3 and ra > rb and ratio >= chance and ra / (ra + rb) >= purity:
            score[term] = math.log(ra / rb)
    left = {i: s & score.keys() for i, s in enumerate(have) if s}
    owed = dict.fromkeys(left, depth)
    gain = Counter(t for s in left.values() for t in s)
    out = []
    while gain:
        # Most texts newly covered; among equals the purer, then the longer and more general term.
        best = max(gain, key=lambda t: (gain[t] * min(score[t], 6.0), score[t], len(t[0]), t[1], t[0]))
        if gain[best] < 2:
            break
        out.append((best[0], best[1], round(score[best], 6)))
        for i in [i for i, s in left.items() if best in s]:
            owed[i] -= 1
            if owed[i] == 0:
                gain.subtract(left.pop(i))
        for t in [t for t in gain if t[0].startswith(best[0]) or best[0].startswith(t[0])]:
            del gain[t]
            for s in left.values():
                s.discard(t)
        gain = +gain
    return out


def misspelled(word: str, rng: random.Random) -> str:
    """The word with one edit behind its first letter."""
    k = rng.randrange(1, len(word))
    other = rng.choice("abcdefghijklmnopqrstuvwxyz0123")
    return rng.choice((word[:k] + word[k + 1 :], word[:k] + word[k] + word[k:], word[:k] + other + word[k + 1 :]))


def altered(texts: list[str], toxic: np.ndarray, reader: Reader, seed: int = 1) -> tuple[list[str], list[int]]:
    """Copies that show what labels seldom do: toxic texts with their terms misspelled, clean texts that quote a term."""
    rng = random.Random(seed)
    words = [t for t, b in reader.auto.terms if not b and len(t) >= FUZZY_WORD]
    out, marks = [], []
    for t, y in zip(texts, toxic, strict=True):
        if y:
            hits = reader.look_up(set(map(str.lower, WORD.findall(t))))
            changed = WORD.sub(lambda m: misspelled(m[0], rng) if m[0].lower() in hits and len(m[0]) >= FUZZY_WORD else m[0], t)  # noqa: B023
            if changed != t:
                out.append(changed)
                marks.append(1)
        elif words and rng.random() < 0.2:
            w = rng.choice(words)
            a, b = rng.choice((('"', '"'), ("«", "»"), ("“", "”")))
            parts = t.split(" ")
            k = rng.randrange(len(parts) + 1)
            out.append(" ".join([*parts[:k], f"{a}{w}{b}" if rng.random() < 0.7 else f"the word {w}", *parts[k:]]))
            marks.append(0)
    return out, marks


def fit(texts: list[str], labels: list[int], rounds: int = 400) -> dict:
    """Lexicon and logistic weights from labelled texts."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return PRIOR
    # The lexicon comes from one part, the weights from the rest, so that chance hits don't look certain.
    part = np.arange(len(y)) % 3 != 2 if min(y.sum(), (1 - y).sum()) >= 60 else np.ones(len(y), bool)
    lexicon = learn_lexicon([t for t, p in zip(texts, part, strict=True) if p], y[part])
    probe = Reader(lexicon)
    usual = probe.look_up({w for t, k in zip(texts, y, strict=True) if not k for w in map(str.lower, WORD.findall(t))})
    common = sorted(w for w, h in usual.items() if h[0] == FUZZY)
    reader = Reader(lexicon, common)
    rest = ~part if not part.all() else part
    some, ys = [t for t, p in zip(texts, rest, strict=True) if p], y[rest]
    copies, marks = altered(some, ys, reader)
    x = reader.features(some + copies)
    ys = np.concatenate([ys, np.array(marks, float)])
    x = np.hstack([np.ones((len(x), 1)), x])
    share = min(max(ys.mean(), 1e-3), 1 - 1e-3)
    cost = np.where(ys > 0, 0.15 / share, 0.85 / (1 - share))  # classes as at 15% of toxic texts
    w = np.array([-3.0, 1.0, -0.2, 0.6, -0.2, 0.5, 0.5, 1.5])
    prior = w.copy()
    least = np.array([-np.inf, 0.0, -np.inf, 0.2, -np.inf, 0.0, 0.0, 0.0])
    most = np.array([np.inf, np.inf, 0.0, np.inf, 0.0, np.inf, np.inf, np.inf])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (cost * p * (1 - p))[:, None]).T @ x / len(x) + 0.003 * np.eye(len(w))
        w = np.clip(w + 0.5 * np.linalg.solve(hess, x.T @ (cost * (ys - p)) / len(x) - 0.003 * (w - prior)), least, most)
    return {"lexicon": lexicon, "common": common, "weights": np.round(w, 6).tolist()}


def scorer(model: dict, threshold: float = 0.3):
    reader = Reader([tuple(t) for t in model["lexicon"]], model["common"])
    w = np.array(model["weights"])

    def run(texts: list[str]) -> dict:
        x = reader.features(texts)
        s = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        n = reader.counts
        return {"score": s, "predicted": (s >= threshold).astype(np.int32), "n_abuse": n[:, 0], "n_quoted": n[:, 1], "n_misspelled": n[:, 2]}

    return run


SCHEMA = "score double, predicted int, n_abuse long, n_quoted long, n_misspelled long"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500) -> dict:
    """Fit on at most `sample` rows of each label, none of them held out, those of least hash of their id and text."""
    return fit(*labelled_sample(docs, labels.where(~held_out(id_col)), label_col, sample, id_col, text_col))


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, whether it is held out, score, verdict and hit counts."""
    out = annotate(docs, per_text(lambda: scorer(model, threshold), SCHEMA), id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), *[c for c in out.columns if c != id_col])


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = scorer(model, threshold)
        for s in batches:
            parts = [run(part)["predicted"] == 0 for part in slices(s)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=bool)
        del run
        give_back()

    return docs.where(clean(F.coalesce(F.col(text_col), F.lit(""))))
