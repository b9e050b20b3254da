"""Results come through the methods: each test fails where its method is switched off."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest

from gridlark.llm import licenses, pii, quality, toxicity

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    return duckdb.sql(f"SELECT d.doc_id, d.text, l.quality, l.toxic FROM '{DIR}/documents.parquet' d JOIN '{DIR}/labels.parquet' l USING (doc_id) ORDER BY hash(d.doc_id)").fetchall()


# ---- quality rules


@pytest.fixture(scope="module")
def field(labelled):
    some = labelled[:1500]
    return quality.fit([r[1] for r in some], [r[2] for r in some])


def test_lines_of_one_document_get_both_labels_and_decide(labelled, field):
    rest = labelled[1500:]
    out = quality.judge(field)([r[1] for r in rest])
    several = [i for i, r in enumerate(rest) if r[1].strip().count("\n")]
    assert sum(0 < out["content_share"][i] < 1 for i in several) > 0.1 * len(several)
    good = np.array([r[2] for r in rest]) > 0
    kept = np.array(out["content_share"]) >= 0.5
    assert kept[good].mean() > 0.95 and kept[~good].mean() < 0.1


def test_changes_between_lines_are_learned_and_matter(labelled, field):
    assert max(field["change"]) < -0.2
    texts = [r[1] for r in labelled[1500:]]
    alone = quality.judge(field | {"change": [0.0, 0.0]})(texts)["n_content_lines"]
    assert sum(a != b for a, b in zip(alone, quality.judge(field)(texts)["n_content_lines"], strict=True)) > 10


def test_line_labels():
    texts = ["A line of prose.\nAll rights reserved.", "More of it here.\nAll rights reserved.", "Other prose.\nAll rights reserved.", "x | y | z\nOther prose.\nAll rights reserved.\nx | y | z"]
    rows, known = quality.label_lines(texts, [1, 1, 1, 0])
    assert [[m for _, m in r] for r in rows] == [[1, 0], [1, 0], [1, 0], [0, 1, 0, 0]] and known == ["All rights reserved."]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    chains = [(rng.integers(0, 2, (n, d)).astype(float), rng.integers(0, 2, n).astype(float), 1.0) for n in (1, 3, 4)]
    group = quality._Chains(chains)

    def likelihood(w, change):
        import itertools

        out = 0.0
        for x, y, _ in chains:
            e = x @ w
            score = lambda v: sum(a for a, k in zip(e, v, strict=True) if k) + sum(change[0] * (b > a) + change[1] * (b < a) for a, b in zip(v, v[1:], strict=False))  # noqa: E731, B023
            out += score(tuple(y)) - np.log(sum(np.exp(score(v)) for v in itertools.product((0, 1), repeat=len(y))))
        return out

    w, change = rng.normal(size=d) * 0.3, np.array([-0.7, -0.2])
    grad, cross = group.gradient(w, change)
    for k in (0, 3, 7):
        step = np.eye(d)[k] * 1e-5
        assert grad[k] == pytest.approx((likelihood(w + step, change) - likelihood(w - step, change)) / 2e-5, abs=1e-3)
    for k in range(2):
        step = np.eye(2)[k] * 1e-5
        assert cross[k] == pytest.approx((likelihood(w, change + step) - likelihood(w, change - step)) / 2e-5, abs=1e-3)


# ---- toxicity: fitted on one part of the rows that are not held out, tested on another


@pytest.fixture(scope="module")
def toxic(labelled):
    part = lambda i: zlib.crc32(str(i).encode()) % 4
    fit = [r for r in labelled if part(r[0]) in (0, 1)]
    return toxicity.fit([r[1] for r in fit], [r[3] for r in fit]), [r for r in labelled if part(r[0]) == 3]


def test_misspelled_terms_are_caught_and_quoted_ones_left(toxic):
    model, rest = toxic
    run, rng = toxicity.scorer(model), random.Random(5)
    terms = [t for t, b, _ in model["lexicon"] if not b]
    clean = [r[1].split() for r in rest if not r[3]]
    got = collections.Counter()
    for w in terms:
        for _ in range(8):
            base = rng.choice(clean)[: rng.randint(10, 60)]
            k = rng.randrange(len(base) + 1)
            put = lambda x: " ".join([*base[:k], x, *base[k:]])  # noqa: E731, B023
            for name, p in zip(("none", "exact", "misspelled", "quoted", "said"), run([put(""), put(w), put(toxicity.misspelled(w, rng)), put(f'"{w}"'), put(f"they said {w}")])["predicted"], strict=True):
                got[name] += int(p)
    n = 8 * len(terms)
    assert len(terms) >= 8 and got["exact"] >= 0.95 * n and got["misspelled"] >= 0.9 * n
    assert got["none"] <= 0.02 * n and got["quoted"] <= 0.15 * n and got["said"] <= 0.15 * n


def test_without_the_levenshtein_part_misspelled_terms_are_missed(toxic, monkeypatch):
    model, rest = toxic
    texts = [r[1] for r in rest if r[3]]
    copies, _ = toxicity.altered(texts, np.ones(len(texts)), toxicity.Reader([tuple(t) for t in model["lexicon"]], model["common"]), seed=3)
    with_ = sum(toxicity.scorer(model)(copies)["predicted"])
    monkeypatch.setattr(toxicity, "FUZZY_WORD", 99)
    monkeypatch.setattr(toxicity, "FUZZY_STEM", 99)
    assert with_ > sum(toxicity.scorer(model)(copies)["predicted"]) + 0.3 * len(copies)


def test_verdicts_on_rows_not_fitted_on(toxic):
    model, rest = toxic
    p = np.array(toxicity.scorer(model)([r[1] for r in rest])["predicted"])
    y = np.array([r[3] for r in rest])
    assert p[y == 1].mean() > 0.75 and p[y == 0].mean() < 0.02


def test_words_whose_lower_case_is_longer_keep_their_quotation():
    reader = toxicity.Reader([("idiot", False, 5.0)])
    assert reader.features(['İstanbul: they said "idiot" to me'])[0, 1] > 0


# ---- personal data


@pytest.fixture(scope="module")
def private():
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DIR}/documents.parquet' WHERE regexp_matches(text, '[0-9@]') ORDER BY hash(doc_id)").fetchall()]
    return pii.fit(texts[::2][:1000]), texts[1::2]


def found_again(model, texts):
    """Share of mentions in other forms that are found, by kind, and spans that are none."""
    rng, run = random.Random(9), pii.finder(model)
    hit, all_, wrong = collections.Counter(), collections.Counter(), 0
    for t in texts:
        text, marks = pii.written_into(t, rng)
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in run([text])["spans"][0].split(",") if x)]
        known = [(pii.LABELS[k], a, b) for k, a, b in marks] + [(pii.LABELS[k + 1], a, b) for k, rows in enumerate([*pii.base_spans(text), pii.secrets(text)]) for a, b in rows]
        for k, s, e in marks:
            all_[pii.LABELS[k]] += 1
            hit[pii.LABELS[k]] += any(x == pii.LABELS[k] and a < e and b > s for x, a, b in spans)
        wrong += sum(not any(a < e and b > s for _, s, e in known) for _, a, b in spans)
    return {k: hit[k] / n for k, n in all_.items()}, wrong


def test_other_mentions_are_found_by_kind(private):
    model, texts = private
    share, wrong = found_again(model, texts)
    assert set(share) == set(pii.LABELS[1:]) and min(share.values()) >= 0.9, share
    assert wrong <= 0.02 * len(texts)


def test_skip_edges_carry_kinds(private):
    model, texts = private
    share, _ = found_again(model | {"skip": 0.0}, texts)
    assert share["phone"] < 0.5  # without them a number's other forms are lost
    assert model["skip"] > 2


def test_mailbox_names_without_digits_and_very_long_tokens(spark):
    t = "Write to anna.meyer@x.org. " + "words go here " * 50 + "then anna.meyer answers, or anna (at) x (dot) org. " + "9" * 5000
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    res = {r.doc_id: r for r in pii.find_pii(df).collect()}
    spans = [t[int(x.split(":")[1]) : int(x.split(":")[2])] for x in res[1].spans.split(",")]
    assert "anna.meyer@x.org" in spans and "anna.meyer" in spans
    assert res[2].spans == res[3].spans == ""


def test_messages_on_a_tree_are_exact():
    """On a chain of three nodes beliefs are the marginals of all labelings."""
    import itertools

    rng = np.random.default_rng(1)
    text = "a1 b2 c3"
    toks, label, feats = pii.nodes_of(text, [[], [], [], []])
    model = {"unary": (rng.normal(size=(len(pii.LABELS), len(pii.FEATURES)))).tolist(), "chain": 1.3, "skip": 0.0}
    field = pii.Field([(toks, label, feats)])
    belief, same = field.infer(model, np.full(3, -1), rounds=60)
    phi = np.array(feats, float) @ np.array(model["unary"]).T
    want, both, total = np.zeros_like(belief), 0.0, 0.0
    for y in itertools.product(range(len(pii.LABELS)), repeat=3):
        p = np.exp(sum(phi[i, k] for i, k in enumerate(y)) + 1.3 * sum(a == b > 0 for a, b in zip(y, y[1:], strict=False)))
        total += p
        both += p * (y[0] == y[1] > 0)
        for i, k in enumerate(y):
            want[i, k] += p
    assert np.allclose(belief, want / total, atol=1e-4) and same[0] == pytest.approx(both / total, abs=1e-4)


# ---- licences

MIT = """MIT License\n\nCopyright (c) 2024 Some Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software.\n
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


def test_whole_licences_match_and_shares_grade():
    run = licenses.scanner()
    broken = MIT.replace("merge, ", "")
    out = run([MIT, "Prose before. " + MIT + " Prose behind.", broken, GPL, "under the terms of the GNU General Public License, version 2", "The MIT license is one of many.", "nothing"])
    labels = [set(x.split(",")) for x in out["labels"]]
    assert "text:mit" in labels[0] and "text:mit" in labels[1] and "text:mit" not in labels[2] and "disclaimer" in labels[2]
    assert "notice:gpl" in labels[3] and "notice:gpl" in labels[4] and labels[5] == {"mit"}
    assert out["score"][0] == 1.0 and out["score"][3] > out["score"][4] > 0.5 and out["score"][5:] == [0.25, 0.0]


def test_every_template_accepts_its_own_words():
    for name, t in licenses.TEMPLATES.items():
        fixed = [w for w in t.replace("[[", " ").replace("]]", " ").split() if not w.startswith("{{")]
        a = licenses.Automaton(t)
        words = [w.encode() for w in fixed]
        assert a.share(words, [i for i, w in enumerate(words) if w == a.anchor]) == 1.0, name
        short = [w.encode() for w in fixed if w != a.anchor.decode()]
        assert not a.found(short, list(range(len(short)))), name


def test_spdx_markup():
    t = licenses.from_spdx('<<beginOptional>>The Title<<endOptional>> Copyright <<var;name="c";original="2020 x";match=".{0,40}">> may be used.')
    a = licenses.Automaton(t)
    ok = lambda x: a.found(licenses.words_of(x), [i for i, w in enumerate(licenses.words_of(x)) if w == a.anchor])
    assert ok("The Title. Copyright 2020 A. Person may be used") and ok("Copyright may be used") and not ok("Copyright 1 may not be used")
