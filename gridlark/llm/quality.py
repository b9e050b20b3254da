"""Quality rules: a linear-chain conditional random field labels lines, Viterbi decoding marks
each as content or boilerplate, and the share of content (in characters) decides retention.

The field is trained here, by gradient ascent on the exact conditional likelihood
(forward-backward) of line labels. Lines of a bounded sample of labelled documents are
labelled so: boilerplate are lines that several sampled documents hold or that repeat in
their document, and lines of low-quality documents that no high-quality one holds; the
rest is content. So documents mix both, and changes between lines are learned as well. The hashes
of lines that several sampled documents hold are part of the model (feature `known`).
While fitting, chains of more than SEGMENT lines are cut into several; all lines count.
Without labels of both kinds a fixed prior model is used.

Defined cases: null and empty texts have no words and fail the base rule; blank lines
carry no label; very long texts and lines are read whole; repeated rows and ids are judged
alone; a label given twice for an id counts as the larger; where Viterbi's paths tie, a
label is kept rather than changed, and content goes before boilerplate at the end; an empty
table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import annotate, labelled_sample, per_text

#: Symbols of the contract.
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"

FEATURES = ("bias", "short", "long", "symbols", "many_symbols", "caps", "digits", "stop", "repeat", "few_kinds", "pipe", "bang", "markup", "link", "opens", "one_word", "known", "last")
SEGMENT = 256


def line_features(line: str, seen: bool, known: bool = False, last: bool = False) -> list[float]:
    """Binary features of one non-blank line, in the order of FEATURES."""
    n = len(line)
    words = line.split()
    syms = sum(map(line.count, SYMBOLS))
    upper = sum(map(str.isupper, words))
    return [
        1.0,
        n < 30,
        n > 120,
        syms > 0,
        syms * 20 > n,
        upper * 2 > len(words),
        sum(map(str.isdigit, line)) * 5 > n,
        line.rstrip().rstrip("\"'”»)")[-1:] in {".", "!", "?", "…", "。"},
        seen,
        len(words) >= 6 and len(set(words)) * 2 < len(words),
        line.count("|") >= 2,
        line.count("!") * 3 > len(words),
        "<" in line and ">" in line,
        "http" in line or "www." in line,
        line[:1].isupper(),
        len(words) <= 1,
        known,
        last,
    ]


#: Prior weights towards content, by feature; of a change to content and to boilerplate between lines; no known lines.
PRIOR: dict = {"weights": [0.8, -0.1, 0.4, -0.8, -1.5, -1.5, -0.5, 0.5, -0.8, -1.5, -1.5, -1.5, -0.5, -0.8, 0.1, -0.2, -1.5, 0.0], "change": [-1.0, -1.0], "known": []}


def viterbi(emit: np.ndarray, change: tuple[float, float]) -> np.ndarray:
    """Best labels (1 content) of one chain.

    emit: each line's score for content against boilerplate; change: the scores of a
    change to content and of a change to boilerplate.
    """
    n = len(emit)
    if n == 0:
        return np.zeros(0, dtype=np.int8)
    rise, fall = change
    e = emit.tolist()
    a, b = 0.0, e[0]  # best score ending in boilerplate, in content
    back = []
    for x in e[1:]:
        fa, fb = b + fall > a, a + rise > b
        back.append((fa, fb))
        a, b = (b + fall if fa else a), (a + rise if fb else b) + x
    label = 1 if b >= a else 0
    out = [label]
    for fa, fb in reversed(back):
        if (fb if label else fa):
            label = 1 - label
        out.append(label)
    return np.array(out[::-1], dtype=np.int8)


def line_key(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))


def label_lines(texts: list[str], good: list[int], several: int = 4) -> tuple[list[list[tuple[str, int]]], list[str]]:
    """Each text's non-blank lines with labels (1 content), and the lines that `several` texts hold or more."""
    held: Counter = Counter()
    fine: set[str] = set()
    split = [[x for x in t.split("\n") if x.strip(_SPACE)] for t in texts]
    for lines, y in zip(split, good, strict=True):
        kinds = set(lines)
        held.update(kinds)
        if y:
            fine |= kinds
    out = []
    for lines, y in zip(split, good, strict=True):
        seen: set[str] = set()
        rows = []
        for x in lines:
            boilerplate = held[x] >= several or x in seen or (not y and x not in fine)
            rows.append((x, int(not boilerplate)))
            seen.add(x)
        out.append(rows)
    return out, sorted(x for x, n in held.items() if n >= several)


class _Chains:
    """Equally padded chains of one length class, for forward-backward over all of them at once."""

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray, float]]):
        n, most, d = len(chains), max(len(c[0]) for c in chains), len(FEATURES)
        self.x, self.y = np.zeros((most, n, d), dtype=np.float32), np.zeros((most, n))
        self.mask, self.weight = np.zeros((most, n), bool), np.array([c[2] for c in chains])
        for i, (x, y, _) in enumerate(chains):
            self.x[: len(x), i], self.y[: len(x), i], self.mask[: len(x), i] = x, y, True

    def gradient(self, w: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the weighted log-likelihood, by feature weights and by the two changes."""
        most, n = self.y.shape
        emit = self.x @ w.astype(np.float32)
        step = np.array([[1.0, np.exp(change[0])], [np.exp(change[1]), 1.0]])  # from, to: boilerplate, content
        top = np.maximum(emit, 0.0)
        local = np.stack([np.exp(-top), np.exp(emit - top)], 2).astype(np.float64)
        alpha, beta, scale = np.zeros((most, n, 2)), np.ones((most, n, 2)), np.ones((most, n))
        alpha[0] = local[0]
        for t in range(most):
            if t:
                alpha[t] = np.where(self.mask[t][:, None], (alpha[t - 1] @ step) * local[t], alpha[t - 1])
            scale[t] = alpha[t].sum(1)
            alpha[t] /= scale[t][:, None]
        for t in range(most - 2, -1, -1):
            b = (beta[t + 1] * local[t + 1]) @ step.T
            beta[t] = np.where(self.mask[t + 1][:, None], b / b.sum(1, keepdims=True), beta[t + 1])
        both = alpha * beta
        content = both[:, :, 1] / both.sum(2)
        miss = (self.y - content) * self.mask * self.weight
        grad = np.einsum("tn,tnd->d", miss, self.x)
        pair = alpha[:-1, :, :, None] * step[None, None] * (beta[1:] * local[1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        on = self.mask[1:] * self.weight
        rise = (self.y[1:] > self.y[:-1]).astype(float) - pair[:, :, 0, 1]
        fall = (self.y[1:] < self.y[:-1]).astype(float) - pair[:, :, 1, 0]
        return grad, np.array([(rise * on).sum(), (fall * on).sum()])


def fit(texts: list[str], good: list[int], rounds: int = 60, several: int = 4) -> dict:
    """Weights of the field from texts labelled good (1) or not (0)."""
    if len(set(good)) < 2:
        return PRIOR
    labelled, known = label_lines(texts, good, several)
    keys = {line_key(x) for x in known}
    share = sum(good) / len(good)
    chains = []
    for rows, y in zip(labelled, good, strict=True):
        feats = features_of([x for x, _ in rows], keys)[0]
        marks = np.array([m for _, m in rows], dtype=float)
        cost = 0.5 / share if y else 0.5 / (1 - share)
        for s in range(0, len(rows), SEGMENT):
            chains.append((feats[s : s + SEGMENT], marks[s : s + SEGMENT], cost))
    chains.sort(key=lambda c: len(c[0]))
    total = sum(len(c[0]) * c[2] for c in chains)
    if not chains or total == 0:
        return PRIOR
    groups: dict[int, list] = {}
    for c in chains:
        groups.setdefault(int(len(c[0]) - 1).bit_length(), []).append(c)
    groups = [_Chains(g) for g in groups.values()]
    w0, c0 = np.array(PRIOR["weights"]), np.array(PRIOR["change"])
    w, change = w0.copy(), c0.copy()
    vel, vel_c = np.zeros_like(w), np.zeros(2)
    for _ in range(rounds):
        grad, cross = np.zeros_like(w), np.zeros(2)
        for g in groups:
            x, y = g.gradient(w, change)
            grad, cross = grad + x, cross + y
        vel = 0.85 * vel + grad / total - 1e-4 * (w - w0)
        vel_c = 0.85 * vel_c + cross / total - 1e-4 * (change - c0)
        w, change = w + 1.5 * vel, change + 1.5 * vel_c
    return {"weights": np.round(w, 6).tolist(), "change": np.round(change, 6).tolist(), "known": sorted(keys)}


def features_of(lines: list[str], known: set[int] | frozenset[int] = frozenset()) -> tuple[np.ndarray, list[int]]:
    """Features and lengths of the lines that hold a word."""
    seen: set[str] = set()
    rows, sizes = [], []
    lines = [x for x in lines if x.strip(_SPACE)]
    for k, line in enumerate(lines):
        rows.append(line_features(line, line in seen, bool(known) and line_key(line) in known, k == len(lines) - 1))
        sizes.append(len(line))
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES)), sizes


def base_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the contract."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.strip(_SPACE):
            seen.add(line)
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        k = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
        pair = k[:-1] * len(ids) + k[1:]
        if len(ids) < 2_000_000:
            key = pair[:-1] * len(ids) + k[2:]
        else:
            key = np.unique(pair, return_inverse=True)[1][:-1] * np.int64(len(ids)) + k[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[j : n - 2 + j] |= twice
        repeat = int(covered.sum())
    return n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), dups, repeat


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_content_lines long"


def judge(model: dict, least_share: float = 0.5):
    """A function from texts to the rules' columns."""
    w, change, known = np.array(model["weights"]), tuple(model["change"]), frozenset(model["known"])
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]

    def run(texts: list[str]) -> dict:
        out: dict[str, list] = {k: [] for k in names}
        for text in texts:
            base = base_of(text)
            n, repeat = base[0], base[4]
            failed = n < 50 or 100 * repeat > 50 * n
            feats, sizes = features_of(text.split("\n"), known)
            marks = viterbi(feats @ w, change)
            total = sum(sizes)
            share = float(np.dot(marks, sizes)) / total if total else 0.0
            row = (*base, failed, not failed and share >= least_share, share, int(marks.sum()))
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        return out

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 1500) -> dict:
    """Fit the field on at most `sample` documents of each label, those of least hash of their id and text."""
    return fit(*labelled_sample(docs, labels, label_col, sample, id_col, text_col))


def quality_rules(docs: DataFrame, model: dict = PRIOR, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: base counts, base verdict, content share and the final verdict."""
    return annotate(docs, per_text(lambda: judge(model, least_share), SCHEMA), id_col, text_col)
