"""The pipeline's near-dedup stage against plain Jaccard similarity of all pairs."""

import random
import re
import time
from itertools import combinations

import corpus_pipeline
from gridlark.llm import nearcopies, simhash
from gridlark.llm.components import components
from gridlark.runtime import release

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Smallest id reachable over pairs of similarity 0.8 or more, by id."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    least = {i: i for i in sets}
    near = [(i, j) for (i, a), (j, b) in combinations(sets.items(), 2) if not (a or b) or 5 * len(a & b) >= 4 * len(a | b)]
    while True:
        before = dict(least)
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            return least


def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    out = [None, "", " ", "one", "One", "one two three four"]
    for n in (4, 5, 6, 30, 100, 400):
        for _ in range(4):
            base = some(n)
            out.append(" ".join(base))
            for changes in (1, 2, 3, 5, 8):
                other = list(base)
                for _ in range(changes):
                    other[rng.randrange(n)] = rng.choice(words)
                out.append(" ".join(other))
    line = some(60)  # a passage of many texts, and a large group of near copies in a chain
    out += [" ".join(line + some(rng.randint(5, 60))) for _ in range(60)]
    chain = some(120)
    for _ in range(60):
        chain[rng.randrange(120)] = rng.choice(words)
        out.append(" ".join(chain))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_groups_are_those_of_all_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert len(set(want.values())) < len(rows) - 60
    assert {r[0]: r[1] for r in nearcopies.near_groups(docs, block=7).collect()} == want  # meetings cut into blocks


def test_the_stage_drops_a_near_copy_that_radius_2_keeps(spark):
    words = [f"v{k * k}" for k in range(400)]
    edited = [f"x{k}" if k % 65 == 30 else w for k, w in enumerate(words)]
    one, two = " ".join(words), " ".join(edited)
    a, b = simhash.fingerprints([one, two])
    assert int(a ^ b).bit_count() > 2
    docs = spark.createDataFrame([(1, one), (2, two), (3, " ".join(words[::-1])), (None, one), (None, "alone")], "doc_id long, text string")
    assert sorted(r[0] or 0 for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 1, 3]


def test_links_come_from_the_bit_sliced_comparison(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    narrow = {r[0]: r[1] for r in nearcopies.near_groups(docs, radius=0).collect()}
    want = plain(rows)
    assert {r[0]: r[1] for r in nearcopies.near_groups(docs).collect()} == want
    assert sum(k != v for k, v in narrow.items()) < sum(k != v for k, v in want.items()) - 30


def test_the_stage_leaves_few_shuffles_on_disk(spark, monkeypatch):
    """What earlier steps have shuffled is deleted while the stage runs, so its files do not pile up."""
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    live, write = [], nearcopies.materialize

    def counted(df):
        out = write(df)
        live.append(tracker.shuffleStatuses().size())
        return out

    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    docs.count()
    release(spark)
    time.sleep(2)
    before = tracker.shuffleStatuses().size()
    monkeypatch.setattr(nearcopies, "materialize", counted)
    nearcopies.dedup(docs).count()
    assert len(live) >= 8 and max(live) - before <= 25


def test_few_links_are_contracted_as_many_are(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(50)] + [(-7, k) for k in range(100, 130)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(2**62, -(2**62)), (5, 5), (3000, 3000)]
    df = spark.createDataFrame(links, "a long, b long")
    one, two = (sorted(map(tuple, components(df, few).collect())) for few in (0, 1000))
    assert one == two and len(one) > 100
    assert components(df.limit(0), 1000).count() == 0
