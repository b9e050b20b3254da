"""Personal data: pattern spans, extended by a skip-chain conditional random field.

Nodes are tokens that hold a digit or an at sign, tokens that spell one out ("(at)",
"[dot]") with their neighbours, and words equal to the mailbox name of an address in the same
text. Neighbours share a chain potential; tokens of one text with the same or similar content
(equal lower-case form, equal last seven digits, a mailbox name) share a skip potential,
however far apart. Loopy belief propagation (sum-product in log space) makes labels
consistent over the text. Tokens inside a pattern span are clamped to its kind, so other
mentions of it (a bare repeat, other separators, a spelled-out address) get that kind too.
Credentials behind a word such as `token` or `password` are a fifth kind, `secret`.

Unary, chain and skip potentials are all learned here, by gradient ascent on the field's
likelihood with expectations from the same message passing, on a bounded sample of texts. Its
labels are the pattern spans, and further mentions of them that are written into the texts in
forms no pattern matches, beside numbers that are no personal data.

Defined cases: null and empty texts have no spans; a token may lie in spans of two
kinds (the first kind listed clamps it); very long texts and tokens are read whole; repeated
rows and ids are judged alone; beliefs that tie go to the kind listed first; an empty table
gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, per_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
#: The contract's patterns, in forms that take linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: How at signs and dots are spelled out, and words in front of credentials.
_SPELLED = re.compile(r"[\[({](?:at|dot|\.)[\])}]", re.I)
_HAS = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
_CREDENTIAL = re.compile(r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"'\x20]{0,2}[=:][\x20]?[\"']?([A-Za-z0-9_/+=.-]{12,})", re.I)
_KEYWORD = re.compile(r"(?:token|secret|password|passwd|pwd|key)[\"'\x20]{0,2}(?:[=:]|is)?[\x20]?$", re.I)
_PUNCT = ".,;:!?()[]{}\"'<>#*$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the at signs outwards."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in _DOMAIN.finditer(text):
        s = m.start()
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            end = m.end()
            out.append((s, end))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        out[0] = emails(text)
    if _DIGIT.search(text):
        out[1] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """Credentials of a plain form: the weak labels of the fifth kind."""
    return [m.span(1) for m in _CREDENTIAL.finditer(text) if _DIGIT.search(m[1])]


FEATURES = ("bias", "at", "three_dots", "dots", "plus", "bracket", "all_digits", "digits_0", "digits_1_3", "digits_4_8", "digits_9_12", "digits_13_19", "digits_20", "hyphen", "spelled", "beside_spelled", "hex", "keyword", "symbols", "letters")


def features(token: str, keyword: bool, beside: bool) -> list[float]:
    core = token.strip(_PUNCT)
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    return [
        1.0,
        "@" in core,
        core.count(".") == 3,
        core.count(".") in (1, 2),
        core.startswith("+") or token.startswith("+"),
        "(" in token or ")" in token,
        0 < digits == len(core),
        digits == 0,
        1 <= digits <= 3,
        4 <= digits <= 8,
        9 <= digits <= 12,
        13 <= digits <= 19,
        digits >= 20,
        "-" in core,
        _SPELLED.search(token) is not None,
        beside,
        len(core) >= 16 and letters > 0 and digits > 0 and letters + digits == len(core),
        keyword,
        any(c in "/:%€£=" for c in core),
        letters > digits,
    ]


def nodes_of(text: str, spans: list[list[tuple[int, int]]]) -> tuple[list[tuple[int, int, str]], list[int], list[list[float]]]:
    """Nodes (start, end, token), their labels by the spans (0: in none), and their features."""
    found = {m.start(): m.end() for m in _TOKEN.finditer(text)}
    spelled: set[int] = set()
    names = {text[s:e].partition("@")[0].lower() for s, e in spans[0]}
    names = {n for n in names if len(n) >= 4}
    spell = _SPELLED.search(text) is not None
    if names or spell:
        words = [m.span() for m in _WORD.finditer(text)]
        for i, (s, e) in enumerate(words):
            token = text[s:e]
            if names and token.strip(_PUNCT).lower() in names:
                found[s] = e
            if spell and _SPELLED.search(token):
                for k in range(max(0, i - 1), min(len(words), i + 2)):
                    found[words[k][0]] = words[k][1]
                    spelled.add(words[k][0])
    toks = [(s, e, text[s:e]) for s, e in sorted(found.items())]
    label = [0] * len(toks)
    starts = np.array([t[0] for t in toks] or [0])
    for k in range(len(spans) - 1, -1, -1):
        for s, e in spans[k]:
            i = max(0, int(np.searchsorted(starts, s, "right")) - 1)
            while i < len(toks) and toks[i][0] < e:
                if toks[i][1] > s:
                    label[i] = k + 1
                i += 1
    feats = [features(t, _KEYWORD.search(text, max(0, s - 16), s) is not None, s in spelled) for s, _, t in toks]
    return toks, label, feats


def keys_of(token: str) -> list[str]:
    core = token.strip(_PUNCT + "+").lower()
    out = [core] if len(core) >= 4 else []
    digits = re.sub("[^0-9]", "", core)
    if len(digits) >= 7:
        out.append("#" + digits[-7:])
    local = re.split(r"@|[\[({]at[\])}]", core)[0]
    if local != core and len(local) >= 4:
        out.append(local)
    return out


def edges_of(toks: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges and skip edges of one text."""
    chain = [(i, i + 1) for i in range(len(toks) - 1) if toks[i + 1][0] - toks[i][1] <= 1]
    skip: set[tuple[int, int]] = set()
    last: dict[str, tuple[int, int]] = {}
    for i, t in enumerate(toks):
        for k in keys_of(t[2]):
            first, before = last.get(k, (i, i))
            skip |= {(j, i) for j in (first, before) if j != i}
            last[k] = (first, i)
    return chain, sorted(skip)


class Field:
    """The fields of several texts as one graph, for message passing over all of them at once."""

    def __init__(self, texts: list[tuple]):
        """texts: (nodes, labels, features) of each, as nodes_of gives them."""
        chain, skip, feats, labels, at = [], [], [], [], 0
        for toks, label, rows in texts:
            c, k = edges_of(toks)
            chain += [(a + at, b + at) for a, b in c]
            skip += [(a + at, b + at) for a, b in k]
            feats += rows
            labels += label
            at += len(toks)
        self.x = np.array(feats, float).reshape(at, len(FEATURES))
        self.labels = np.array(labels, dtype=np.int64)
        pairs = np.array(chain + skip, dtype=np.int64).reshape(-1, 2)
        self.is_skip = np.concatenate([np.zeros(len(chain), bool), np.ones(len(skip), bool)])
        self.a, self.b = pairs[:, 0], pairs[:, 1]
        self.src, self.dst = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a])
        n = len(self.a)
        self.back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])

    def infer(self, model: dict, clamp: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs [nodes, labels] and each edge's belief that both ends have one label (not none).

        clamp: labels of the nodes that are known, -1 elsewhere.
        """
        phi = self.x @ np.array(model["unary"]).T
        known = np.nonzero(clamp >= 0)[0]
        phi[known] = -40.0
        phi[known, clamp[known]] = 0.0
        pot = np.where(self.is_skip, model["skip"], model["chain"])
        gain = np.expm1(np.concatenate([pot, pot]))[:, None]
        kinds = np.ones(len(LABELS))
        kinds[0] = 0.0  # agreement counts for kinds, not for none: most neighbours share nothing else
        msg = np.zeros((len(self.src), len(LABELS)))
        belief = phi
        for _ in range(rounds if len(self.a) else 0):
            belief = phi.copy()
            np.add.at(belief, self.dst, msg)
            out = belief[self.src] - msg[self.back]
            top = out.max(1, keepdims=True)
            p = np.exp(out - top)
            new = np.log(p.sum(1, keepdims=True) + p * gain * kinds) + top
            new -= new.max(1, keepdims=True)
            msg = 0.5 * msg + 0.5 * new
        if len(self.a):
            belief = phi.copy()
            np.add.at(belief, self.dst, msg)
        n = len(self.a)
        left = belief[self.a] - msg[n:]
        right = belief[self.b] - msg[:n]
        left, right = np.exp(left - left.max(1, keepdims=True)), np.exp(right - right.max(1, keepdims=True))
        same = (left * right)[:, 1:].sum(1) * np.exp(pot)
        rest = left.sum(1) * right.sum(1) - (left * right)[:, 1:].sum(1)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), same / (same + rest)


def _prior() -> dict:
    """Potentials without a sample: weak unary weights, strong agreement of equal tokens."""
    w = np.zeros((len(LABELS), len(FEATURES)))
    at = FEATURES.index
    w[0, 0] = 2.0
    w[1:, 0] = -2.0
    w[1, at("at")], w[1, at("spelled")] = 3.0, 2.0
    w[2, at("three_dots")] = 3.0
    w[3, at("digits_13_19")] = 1.0
    w[4, at("plus")] = 2.0
    w[5, at("hex")] = w[5, at("keyword")] = 2.0
    return {"unary": w.tolist(), "chain": 0.5, "skip": 7.0}


PRIOR = _prior()


def other_mention(kind: int, found: str, rng: random.Random) -> list[str]:
    """Words that mention the span again in a form that no pattern matches."""
    digits = re.sub("[^0-9]", "", found)
    if kind == 0:
        local, _, domain = found.partition("@")
        spelled = [local, "(at)", *" (dot) ".join(domain.split(".")).split(" ")]
        forms = [[local]] if len(local) >= 4 else []
        forms += [spelled, [f"{local}[at]{domain.replace('.', '[dot]')}"]]
    elif kind == 1:
        forms = [[found.replace(".", "[.]")], [found.replace(".", "-")]]
    elif kind == 2:
        forms = [["_".join(re.findall(".{1,4}", digits))], ["/".join(re.findall(".{1,4}", digits))], [digits[:8] + "." + digits[8:]]]
    elif kind == 3:
        forms = [[digits[-10:]], [f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"], [f"{digits[-7:-4]}-{digits[-4:]}"]]
    else:
        forms = [[found]]
    return rng.choice(forms)


def decoy(rng: random.Random) -> str:
    """A number that is no personal data."""
    n = lambda a, b: str(rng.randint(a, b))
    return rng.choice((n(1, 99), n(1900, 2099), f"{n(1, 99)}.{n(0, 99):0>2}", f"{n(1900, 2099)}-{n(1, 12):0>2}-{n(1, 28):0>2}", f"{n(0, 23)}:{n(10, 59)}", f"{n(1, 99)}%", n(10**9, 10**10 - 1), n(10**13, 10**18), f"{n(1, 999)},{n(100, 999)}", f"v{n(1, 9)}.{n(0, 9)}.{n(0, 99)}"))


def written_into(text: str, rng: random.Random, most: int = 3) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with other mentions of up to `most` of its spans and some decoys, and the mentions (label, start, end)."""
    spans = [*base_spans(text), secrets(text)]
    some = [(k, text[s:e]) for k, rows in enumerate(spans) for s, e in rows]
    rng.shuffle(some)
    cuts = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]|$)", text)]
    blocked = [(s, e) for rows in spans for s, e in rows]
    cuts = [c for c in cuts if not any(s < c < e for s, e in blocked)] if len(blocked) < 50 else cuts[-1:]
    adds = [(k, other_mention(k, x, rng)) for k, x in some[:most]] + [(-1, [decoy(rng)]) for _ in range(rng.randint(0, 2))]
    places = sorted(rng.choice(cuts) for _ in adds) if cuts else []
    out, marks, end, size = [], [], 0, 0
    for at, (k, words) in zip(places, adds, strict=False):
        out.append(text[end:at])
        size += at - end
        end = at
        add = " " + " ".join(words)
        if k >= 0:
            marks.append((k + 1, size + 1, size + len(add)))
        out.append(add)
        size += len(add)
    return "".join(out) + text[end:], marks


def fit(texts: list[str], steps: int = 60, nodes: int = 20_000, seed: int = 1) -> dict:
    """All potentials, from whole texts in the order given, until they have `nodes` nodes."""
    rng = random.Random(seed)
    examples, clamps, n = [], [], 0
    for t in texts:
        if n >= nodes:
            break
        for text, marks in ((t, []), written_into(t, rng)):
            spans = [*base_spans(text), secrets(text)]
            toks, label, feats = nodes_of(text, spans)
            clamp = [k if 0 < k < 5 else -1 for k in label]  # patterns are known when searching, the rest is to be found
            for k, s, e in marks:
                for i, (a, b, _) in enumerate(toks):
                    if a < e and b > s and label[i] == 0:
                        label[i] = k
            examples.append((toks, label, feats))
            clamps += clamp
            n += len(toks)
    if not n:
        return PRIOR
    field, clamp = Field(examples), np.array(clamps)
    target = np.eye(len(LABELS))[field.labels]
    agree = ((field.labels[field.a] == field.labels[field.b]) & (field.labels[field.a] > 0)).astype(float)
    free = (clamp < 0)[:, None]
    open_ = (clamp[field.a] < 0) | (clamp[field.b] < 0)
    w, w0 = np.array(PRIOR["unary"]), np.array(PRIOR["unary"])
    chain, skip = PRIOR["chain"], PRIOR["skip"]
    speed = np.zeros_like(w)
    scale = np.maximum(1.0, ((target * free).sum(0) * 0.02 + free.sum() * 0.002))[:, None]  # rare kinds learn as fast
    for _ in range(steps):
        belief, same = field.infer({"unary": w, "chain": chain, "skip": skip}, clamp, 5)
        grad = ((target - belief) * free).T @ field.x / scale
        speed = 0.8 * speed + 0.02 * grad
        w = w + np.clip(speed, -0.5, 0.5) - 0.002 * (w - w0)
        miss = (agree - same) * open_
        for is_skip in (False, True):
            on = open_ & (field.is_skip == is_skip)
            step = 4.0 * miss[on].sum() / max(1, on.sum())
            if is_skip:
                skip = float(np.clip(skip + step - 0.002 * (skip - PRIOR["skip"]), 0.0, 9.0))
            else:
                chain = float(np.clip(chain + step - 0.002 * (chain - PRIOR["chain"]), 0.0, 9.0))
    return {"unary": np.round(w, 6).tolist(), "chain": round(chain, 6), "skip": round(skip, 6)}


def finder(model: dict, threshold: float = 0.8):
    """A function from texts to the search's columns."""

    def run(texts: list[str]) -> dict:
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        out: dict[str, list] = {k: [] for k in names}
        bases, examples, which = [], [], []
        for d, text in enumerate(texts):
            spans: list[list[tuple[int, int]]] = [[], [], [], []]
            if _HAS.search(text):
                spans = base_spans(text)
                example = nodes_of(text, spans)
                if 0 in example[1]:
                    examples.append(example)
                    which.append(d)
            bases.append(spans)
        added: list[list[list[tuple[int, int]]]] = [[[] for _ in LABELS[1:]] for _ in texts]
        if examples:
            field = Field(examples)
            belief, _ = field.infer(model, np.where(field.labels > 0, field.labels, -1))
            at = 0
            for d, (toks, label, _) in zip(which, examples, strict=True):
                own = belief[at : at + len(toks)]
                at += len(toks)
                before, kind_before = -1, 0
                for i in np.nonzero((own[:, 1:].max(1) >= threshold) & (np.array(label) == 0))[0].tolist():
                    k = int(own[i, 1:].argmax())
                    s, e, token = toks[i]
                    core = token.strip(_PUNCT)
                    if not core and not _SPELLED.search(token):
                        continue
                    if core:
                        s += token.index(core)
                        e = s + len(core)
                    rows = added[d][k]
                    if rows and before == i - 1 and kind_before == k and s - rows[-1][1] <= 3:  # neighbours of one kind are one span
                        s = rows.pop()[0]
                    rows.append((s, e))
                    before, kind_before = i, k
        text_of = lambda rows: ",".join(f"{LABELS[k + 1]}:{s}:{e}" for k in range(len(rows)) for s, e in sorted(set(rows[k])))
        for spans, more in zip(bases, added, strict=True):
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(len(spans[k]))
            out["base_sha256"].append(hashlib.sha256(text_of(spans).encode()).hexdigest())
            out["spans"].append(text_of([*[spans[k] + more[k] for k in range(4)], more[4]]))
            out["n_added"].append(sum(map(len, more)))
            out["n_secret"].append(len(more[4]))
            out["n_spans"].append(sum(map(len, spans)) + sum(map(len, more)))
        return out

    return run


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long"


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000) -> dict:
    """Fit on at most `sample` texts that hold a digit or an at sign: those of least hash of id and text.

    Only hashes are ranked; texts are fetched for the chosen ones, so what reaches the
    driver does not grow with the number of tasks. Rows of one hash are equal in id and text.
    """
    rows = docs.select(F.xxhash64(id_col, text_col).alias("__h"), F.col(text_col).alias("__t")).where(F.col("__t").rlike("[0-9@]"))
    least = [r[0] for r in rows.select("__h").distinct().orderBy("__h").limit(sample).collect()]
    if not least:
        return fit([])
    got = rows.where(F.col("__h") <= least[-1]).dropDuplicates(["__h"]).orderBy("__h").limit(sample).collect()
    return fit([r["__t"] for r in got])


def find_pii(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: pattern counts and digest, and all spans with those the field adds."""
    return annotate(docs, per_text(lambda: finder(model or PRIOR, threshold=threshold), SCHEMA), id_col, text_col)


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of find_pii's result replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def mask(t, s):
        out = []
        for text, listed in zip(t, s, strict=True):
            text, cuts = text or "", []
            for item in (listed or "").split(","):
                if item:
                    kind, a, b = item.split(":")
                    cuts.append((int(a), int(b), kind))
            end, parts = 0, []
            for a, b, kind in sorted(cuts):
                if a >= end:
                    parts += [text[end:a], f"[{kind}]"]
                end = max(end, b)
            out.append("".join(parts) + text[end:])
        return __import__("pandas").Series(out, dtype=object)

    pairs = spans.select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans")).dropDuplicates(["__id"])
    return docs.join(pairs, docs[id_col].eqNullSafe(pairs["__id"]), "left").withColumn(text_col, mask(F.col(text_col), "__spans")).drop("__id", "__spans")
