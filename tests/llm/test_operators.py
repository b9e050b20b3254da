"""Each operator against a plain version on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from gridlark.llm import exact, licenses, mixing, nearcopies, piece, pii, quality, simhash, tokencount, toxicity
from gridlark.llm.queries import model_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __id string, size long, fp string"


def rows():
    rng = random.Random(5)
    syl = "ba co du fe gi ho ju ka lé mo nü pa".split()
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) + rng.choice(["", ".", "\n", "!\nx | y | z"]) for _ in range(60)]
    texts += [None, "", " ", "\n\t ", "one", "two words", texts[0], texts[0].replace(" ", "  "), texts[1] + " end", "x" * 3000, "Zz" * 5, "日本 語 text 🙂", " nbsp em", "a\x00b c"]
    texts += [" ".join(["same"] * 80), "\n".join(["line one here", "line one here", "", "other"] * 3), texts[5], texts[5]]
    texts += ["mail a.b@c.org, again a.b and +1 (212) 555-7713 or 2125557713; card 4111 1111 1111 1111 ip 1.2.3.4 and 1.2.3.400 and 9@@x.y@z.co", "Licensed under the Apache License, Version 2.0. CC BY mit license"]
    out = [(k, t, "en", rng.choice(["s1", "s2", "s3", None]), len(t or ""), 0.5, "i", 1, "f") for k, t in enumerate(texts)]
    return out + [out[3], (None, "no id", None, None, None, None, None, None, None), (None, texts[2], "en", "s1", 1, 0.0, "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_operator_takes_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        tokencount.count_tokens(empty, model_path()),
        toxicity.score_toxicity(empty, toxicity.train(empty, labels)),
        toxicity.drop_toxic(empty, toxicity.PRIOR),
        quality.quality_rules(empty, quality.train(empty, labels)),
        exact.groups(empty),
        exact.dedup(empty),
        mixing.takes(empty),
        mixing.blocks(empty),
        mixing.mixed_documents(empty),
        piece.encode_digests(empty, model_path()),
        simhash.near_groups(empty),
        nearcopies.near_groups(empty),
        nearcopies.dedup(empty),
        pii.find_pii(empty, pii.train(empty)),
        licenses.scan_licenses(empty),
    ):
        assert df.count() == 0


def test_token_counts(docs):
    from tokenizers import Tokenizer, models

    pieces, _ = tokencount.unigram_scores(model_path())
    other = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256))], 0, True))
    want = []
    for r in rows():
        words = re.findall(WORD, r[1] or "")
        want.append((r[0], len(r[1] or ""), len(words), sum(len(e.ids) for e in other.encode_batch(["▁" + w for w in words]))))
    assert got(tokencount.count_tokens(docs, model_path())) == sorted(want, key=repr)


def test_trie_equals_plain():
    count = tokencount.TrieCounter([("▁", -1.0), ("a", -2.0), ("ab", -2.5), ("b", -2.0), ("▁ab", -3.5), ("ba", -2.5), ("aba", -4.5)])
    rng = random.Random(2)
    words = {"▁" + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 70))) for _ in range(400)}
    assert count.counts(words) == {w: count.plain(w) for w in words}


def test_exact_groups(docs):
    norm = defaultdict(list)
    for r in rows():
        norm[re.sub(SPACE, " ", r[1] or "")].append(r[0])
    want, once = [], set()
    for t, ids in norm.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want.append((i, keep, len(ids), i == keep and (t, i) not in once, hashlib.sha256(t.encode()).hexdigest()))
            once.add((t, i))
    assert got(exact.groups(docs)) == sorted(want, key=repr)
    assert got(exact.groups(docs, hot=2)) == sorted(want, key=repr)  # salted groups, whose runs are merged
    for hot in (exact.HOT, 1):
        kept = exact.dedup(docs, hot=hot)
        assert kept.columns == docs.columns
        assert Counter(re.sub(SPACE, " ", r[1] or "") for r in kept.collect()) == Counter(norm.keys())


def test_exact_groups_come_from_the_sort(spark, docs, monkeypatch):
    """Without comparison of neighbours no row finds its copies."""
    from pyspark.sql import functions as F

    whole = exact.groups(docs).where("group_size > 1").count()
    lag = F.lag
    monkeypatch.setattr(exact.F, "lag", lambda c: lag(F.concat(F.col(c).cast("string"), F.lit("another"))))
    assert whole > 5 and exact.groups(docs).where("group_size > 1").count() == 0


def test_simhash(docs):
    def fp(t):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    all_rows = [(r[0], fp(r[1])) for r in rows()]
    comp = list(range(len(all_rows)))
    for _ in comp:
        for i, (_, a) in enumerate(all_rows):
            for j, (_, b) in enumerate(all_rows):
                if (a ^ b).bit_count() <= 2:
                    comp[i] = min(comp[i], comp[j])
    least = {c: min((r[0] for r, x in zip(all_rows, comp, strict=True) if x == c and r[0] is not None), default=None) for c in comp}
    want = [(r[0], f"{r[1]:016x}", least[c]) for r, c in zip(all_rows, comp, strict=True)]
    assert got(simhash.near_groups(docs)) == sorted(want, key=repr)


def test_bit_sliced_comparison_and_components(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for c in centre] + [centre, rng.integers(0, 2**63, 500, dtype=np.uint64)])
    fps = np.unique(fps)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for radius in (0, 1, 2, 3, 7, 24, 40):
        assert simhash.within(fps[:-1], fps[1:], radius).tolist() == (np.diagonal(d, 1) <= radius).tolist()
        i, j = simhash.near(fps, fps, radius)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(d <= radius)), strict=True))
    node, root = simhash.forest(len(fps), *np.nonzero(d <= 2))
    plain = np.arange(len(fps))
    plain[node] = root
    signed = fps.view(np.int64)
    classes = spark.createDataFrame([(int(x), int(x)) for x in signed], "fp long, rep long").repartition(3)
    found = {r[0]: r[1] for r in simhash.components(simhash.links(classes, 2, block=64)).collect()}
    groups = defaultdict(set)
    for k, r in enumerate(plain.tolist()):
        groups[r].add(int(signed[k]))
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert {k: v for k, v in found.items() if k != v} == {k: v for k, v in want.items() if k != v}


def test_quality_base(docs):
    def base(t):
        w = re.findall(WORD, t)
        win = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = t.split("\n")
        dup = sum(bool(re.search(WORD, x)) and x in lines[:i] for i, x in enumerate(lines))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)

    res = quality.quality_rules(docs)
    assert got(res.select(*res.columns[:7])) == sorted(((r[0], *base(r[1] or "")) for r in rows()), key=repr)
    assert res.where("base_failed and kept").count() == 0


def test_viterbi_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        emit, change = rng.normal(size=7), (-float(rng.random()), -float(rng.random()))
        score = lambda y: sum(e for e, k in zip(emit, y, strict=True) if k) + sum(change[0] * (b > a) + change[1] * (b < a) for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert tuple(quality.viterbi(emit, change).tolist()) == max(itertools.product((0, 1), repeat=7), key=score)


def test_crf_learns():
    # Every text has lines of its own: lines that many texts hold count as boilerplate, whoever holds them.
    good = [f"Some plain prose number {k} goes here, as it should.\nAnd more of part {k} follows.\nThe end of story {k}." for k in range(30)]
    bad = [f"a{k} | b | c | d\nx | y{k} | z | q\n$$$ %%% &&& *** {k}" for k in range(30)]
    model = quality.fit(good + bad, [1] * 30 + [0] * 30)
    out = quality.judge(model)([" ".join(f"word{k}" for k in range(60)) + ".\nMore text here.", "\n".join(f"k{k} | v{k} | w{k}" for k in range(60))])
    assert out["kept"] == [True, False]


def test_mixing(spark, docs):
    for table, block in ((docs, 4), (docs.where("doc_id % 2 = 0"), 64)):
        res = mixing.takes(table, block=block).collect()
        rws = table.collect()
        assert len(res) == len(rws)
        size = Counter()
        for r in rws:
            size[r.source] += len(re.findall(WORD, r.text or ""))
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, full, left = {}, set(), 1.5 * sum(size.values())
        while True:
            open_ = [s for s in order if s not in full]
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = [s for s in open_ if share[s] > 2 * size[s]]
            if not over:
                target |= share
                break
            for s in over:
                full.add(s)
                target[s] = 2.0 * size[s]
                left -= 2 * size[s]
        took = Counter()
        by_id = {r.doc_id: r.source for r in rws}
        for r in res:
            s = by_id[r.doc_id]
            if r.doc_id is not None:
                assert r.target == pytest.approx(target[s]) and r.source_size == size[s]
            assert 0 <= r.taken <= 2 * r.size
            if r.doc_id is not None:
                took[s] += r.taken
        for s in order:
            if s is not None and s != "s1":  # the rows without id share these two
                assert abs(took[s] - target[s]) <= 2 * block + 0.02 * target[s]
        assert sorted(map(tuple, mixing.takes(table.repartition(5), block=block).collect()), key=repr) == sorted(map(tuple, res), key=repr)


def test_mix_blocks_and_documents_hold_what_is_taken(docs):
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    took = {r.doc_id: r.taken for r in mixing.takes(table, block=8).collect()}
    words = Counter()
    for r in mixing.mixed_documents(table, block=8).collect():
        words[r.doc_id] += len(re.findall(WORD, r.text))
    assert {k: v for k, v in took.items() if v} == dict(words)
    mixed = mixing.blocks(table, block=8).collect()
    assert sum(len(r.words) for r in mixed) == sum(took.values())
    assert len({(r.source, r.slot) for r in mixed}) == len(mixed)


def test_every_shard_draws_its_counts_and_targets_are_met(spark):
    """Shards are full, their counts vary as draws do, and each source has its slots once."""
    planned = mixing.plan(spark.createDataFrame([("a", 60_000), ("b", 200_000), (None, 90_000)], "source string, source_size long"))
    want = {r.source: (r.n_slots, r.n_blocks) for r in planned.collect()}
    rows = mixing.slots(planned, shard=100).collect()
    assert Counter(r.source for r in rows) == {s: n for s, (n, _) in want.items()}
    for s, (n, n_blocks) in want.items():
        mine = [r for r in rows if r.source == s]
        assert sorted(r.slot for r in mine) == list(range(n))
        assert len({(r.turn, r.block) for r in mine}) == n and all(r.turn == r.slot // n_blocks and 0 <= r.block < n_blocks for r in mine)
    shards = Counter(r.shard for r in rows)
    assert set(list(shards.values())) <= {100, sum(n for n, _ in want.values()) % 100}
    drawn = defaultdict(Counter)
    for r in mixing.shard_counts(planned, shard=100).collect():
        drawn[r.shard][r.sid] = r["count"]
    p = want["b"][0] / len(rows)
    counts = [c[1] for k, c in drawn.items() if k < len(rows) // 100]
    mean = sum(counts) / len(counts)
    var = sum((x - mean) ** 2 for x in counts) / len(counts)
    assert abs(mean - 100 * p) < 3 and 0.5 < var / (100 * p * (1 - p)) < 2
    by_shard = defaultdict(Counter)
    for r in rows:
        by_shard[r.shard][("a", "b", None).index(r.source)] += 1
    moved = sum(abs(by_shard[k][s] - c[s]) for k, c in drawn.items() for s in range(3))
    assert moved < 0.1 * len(rows)  # reconciling moves few slots: the draw shows in the mix


def test_repeated_ids_are_rows_of_their_own(spark):
    """Near dedup loses no text and mixing multiplies none where ids repeat."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(90)) for x in "abc")
    rows = [(1, b, "s"), (5, a, "s"), (5, b, "s"), (None, c, "s"), (None, a + " end", "s"), (None, None, "s"), (7, c, "t"), (7, c, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(((r[0], r[1] or "") for r in nearcopies.dedup(docs).collect()), key=repr)
    assert kept == sorted([(1, b), (5, a), (7, c), (None, "")], key=repr)
    words = Counter()
    for r in mixing.mixed_documents(docs, block=8).collect():
        words[(r[0], r[2])] += len(r[1].split())
    took = Counter()
    for r in mixing.takes(docs, block=8).collect():
        took[r.doc_id] += r.taken
    by_id = Counter()
    for (i, _), n in words.items():
        by_id[i] += n
    assert by_id == Counter({k: v for k, v in took.items() if v})


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice("lorem ipsum dolor sit amet consectetur".split()) + str(rng.randint(0, 9)) for _ in range(600_000))
    assert len(long) > 4_000_000
    docs = spark.createDataFrame([(1, long, "s"), (2, long + " more", "s"), (3, "  ".join(long.split(" ")), "s"), (4, "short text", "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in nearcopies.dedup(docs).collect()) == [1, 4]
    assert sorted(r.doc_id for r in exact.dedup(docs).collect()) == [1, 2, 4]
    assert sum(r.taken for r in mixing.takes(docs).collect()) == sum(len(r.text.split()) for r in mixing.mixed_documents(docs).collect())


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"), F.lit(0), 1).alias("x"))
        xs = [r.x for r in df.collect()]
        assert sorted(xs) == list(range(n))
        assert n < 100 or xs != list(range(n))


def test_pieces(docs):
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    digest = lambda ids: hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    want = [(r[0], len(sp.encode(r[1] or "")), digest(sp.encode(r[1] or ""))) for r in rows() if "\0" not in (r[1] or "")]
    res = piece.encode_digests(docs.where("coalesce(instr(text, '\\0'), 0) = 0"), model_path())
    assert got(res.select("doc_id", "n_tokens", "ids_sha256")) == sorted(want, key=repr)
    back = piece.decode(piece.encode(docs, model_path()), model_path())
    assert Counter(r.text for r in back.collect()) == Counter(r[1] or "" for r in rows())


def test_pii(docs):
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def ok(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    rng = random.Random(4)
    texts = ["".join(rng.choice("a.@1 2+-(9") for _ in range(60)) for _ in range(3000)]
    run = pii.finder(pii.PRIOR)
    for batch in (texts, [r[1] or "" for r in rows()]):
        out = run(batch)
        for k, t in enumerate(batch):
            base = {kind: [m.span() for m in re.finditer(p, t) if ok(kind, m[0])] for kind, p in pats.items()}
            text = ",".join(f"{kind}:{a}:{b}" for kind in pats for a, b in base[kind])
            assert [out[f"n_{kind}"][k] for kind in pats] == [len(base[kind]) for kind in pats]
            assert out["base_sha256"][k] == hashlib.sha256(text.encode()).hexdigest()
            assert set(text.split(",")) - {""} <= set(out["spans"][k].split(","))
    assert pii.find_pii(docs).count() == len(rows())


def test_skip_chain_extends_to_repeats(spark):
    t = "Call +1 (212) 555-7713 now. " + "filler words go here " * 20 + "or 2125557713 later, bob.smith99@mail.org or bob.smith99 there, and 77 more."
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    row = pii.find_pii(df).collect()[0]
    spans = [(x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in row.spans.split(",")]
    assert ("phone", "2125557713") in spans and ("email", "bob.smith99") in spans and not any(s == "77" for _, s in spans)
    assert "555" not in pii.redact(df, pii.find_pii(df)).collect()[0].text


def test_licenses(docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

    def base(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hits = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    res = licenses.scan_licenses(docs)
    assert got(res.select(*res.columns[:6])) == sorted(((r[0], *base(r[1] or "")) for r in rows()), key=repr)


def test_templates():
    a = licenses.Automaton("this [[ free ]] software is {{2}} licensed under [[ the [[ new ]] ]] terms")
    ok = lambda t: a.found(licenses.words_of(t), [i for i, w in enumerate(licenses.words_of(t)) if w == a.anchor])
    assert ok("x This software is licensed under terms") and ok("this free software is hereby now licensed under the new terms.")
    assert not ok("this software is so very much licensed under terms") and not ok("this software was licensed under terms")
    assert not ok("this software is licensed under new terms")


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randint(3, 8)))
    def text(bad):
        w = [word() for _ in range(40)]
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["zidiotz", "zmoronz", "zscumz"])
        return " ".join(w)
    data = [(k, text(k % 5 == 0), int(k % 5 == 0)) for k in range(1000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - y, y) for k, _, y in data], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    res = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for k, _, y in data:
        assert res[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert res[k].predicted == y == int(res[k].score >= 0.3)
    flipped = spark.createDataFrame([(k, 1 - y, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, _, y in data], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, flipped) == model
    assert toxicity.drop_toxic(docs, model).count() == 800


def test_toxicity_automaton():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p

    rng = random.Random(1)
    terms = [("idiot", False), ("lowei", True), ("moron", False), ("chlla", True)]
    auto = toxicity.Automaton(terms)
    words = {"".join(rng.choice(rng.choice(terms)[0] + "ax") for _ in range(rng.randint(3, 7))) for _ in range(3000)} | {"idiots", "1diot", "loweixyz", "loei", "lowie", "idiot", "moron"}
    hits = auto.match(sorted(words))
    for w in words:
        d = min(min(distance(t, w)) if beginning else distance(t, w)[-1] for t, beginning in terms)
        assert hits.get(w, (0,))[0] == {0: toxicity.EXACT, 1: toxicity.FUZZY}.get(d, 0), w


def test_quotation_is_told_from_abuse():
    reader = toxicity.Reader([("idiot", False, 5.0)])
    x = reader.features(["you idiot you", 'they said "idiot" to me', "he called me an idiot", "nothing here"])
    assert x[0, 0] > 0 and x[0, 1] == 0 and x[1, 1] > 0 and x[1, 0] == 0 and x[2, 1] > 0 and not x[3].any()


def test_toxicity_takes_awkward_rows(docs):
    res = toxicity.score_toxicity(docs, toxicity.PRIOR)
    assert res.count() == len(rows()) and res.where("score is null or predicted <> 0").count() == 0
