import random

import numpy as np
import pytest

from folioscope.llm import simhash


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def kept(spark, texts, **options):
    return sorted(r.doc_id for r in simhash.without_near_copies(docs(spark, texts), **options).collect())


def brute(texts):
    """Least member of each group, by the similarity of all pairs of sets of five-word shingles."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    has = {}
    for i, x in enumerate(sets):
        for shingle in x:
            has.setdefault(shingle, []).append(i)
    has = {x: np.array(at) for x, at in has.items()}
    at = list(range(len(texts)))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for i, x in enumerate(sets):
        shared = np.zeros(len(sets), dtype=np.int64)
        for shingle in x:
            shared[has[shingle]] += 1
        for j in np.flatnonzero(shared):
            if shared[j] >= 0.8 * (len(x) + len(sets[j]) - shared[j]):
                a, b = find(i), find(int(j))
                at[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def prose(rnd, n):
    return [f"w{rnd.randint(0, 9999)}" for _ in range(n)]


def scattered(rnd, base, n):
    own = list(base)
    for i in rnd.sample(range(len(own)), n):
        own[i] = f"x{rnd.randint(0, 1 << 40)}"
    return " ".join(own)


@pytest.mark.parametrize("n", [20, 400, 2000])
def test_groups_of_variants(spark, n):
    rnd = random.Random(n)
    base = prose(rnd, 200)
    texts = [" ".join(base)] + [scattered(rnd, base, rnd.randint(2, 4)) for _ in range(n)] + [" ".join(prose(rnd, 200)) for _ in range(20)]
    assert kept(spark, texts) == brute(texts)
    assert len(brute(texts)) == 21


def test_block_edits(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(150):
        base = prose(rnd, 300)
        m = rnd.randint(20, 90)
        at = rnd.randint(0, 200)
        texts += [" ".join(base), " ".join(base + prose(rnd, m)), " ".join(base[:-m]), " ".join(base[:at] + prose(rnd, m) + base[at:])]
    want = brute(texts)
    assert kept(spark, texts) == want and 150 < len(want) < 450


@pytest.mark.parametrize("run_rows", [20, 100])
def test_overlong_runs(spark, run_rows):
    rnd = random.Random(4)
    line = prose(rnd, 150)
    texts = []
    for _ in range(60):  # all share most of their shingles, and are copies within sixes
        base = line + prose(rnd, 60)
        texts += [scattered(rnd, base, 2) for _ in range(6)]
    assert kept(spark, texts, run_rows=run_rows) == brute(texts)


def test_repeats_are_no_copies(spark):
    rnd = random.Random(6)
    line = " ".join(prose(rnd, 7)) + " "
    texts = [line * 200 + " ".join(prose(rnd, 120)) for _ in range(8)] + ["same " * 250 + " ".join(prose(rnd, 200)) for _ in range(8)]
    assert kept(spark, texts) == brute(texts) == list(range(16))


def test_overlong_run_of_variants(spark):
    rnd = random.Random(8)
    base = prose(rnd, 200)
    texts = [" ".join(base)] + [scattered(rnd, base, 4) for _ in range(120)]
    assert kept(spark, texts, run_rows=20) == brute(texts) == [0]


def test_dedup_goes_by_fingerprints(spark, monkeypatch):
    """With candidates by fingerprint alone, the stage of the pipeline leaves one of each group of links that are similar."""
    import corpus_pipeline as cp

    rnd = random.Random(12)
    texts = []
    for _ in range(12):
        base = prose(rnd, 400)
        texts += [" ".join(base), " ".join(base) + " end", " ".join(prose(rnd, 300))]
    texts += ["same " * 250 + " ".join(prose(rnd, 200)) for _ in range(4)]  # fingerprints link, sets are unlike
    f = [simhash.fingerprint(t, 5) for t in texts]
    near = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2]
    alike = [i for i, j in near if brute([texts[j], texts[i]]) == [0]]
    assert len(alike) >= 5 and len(near) > len(alike)
    columns = ", ".join(f"{c} long" for c in ["a", "b", "kind", "key", *simhash._ROW])
    monkeypatch.setattr(simhash, "_possible_pairs", lambda *_: lambda rows: spark.createDataFrame([], columns))
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, rows, "").collect()) == sorted(set(range(len(texts))) - set(alike))


@pytest.mark.parametrize("run_rows", [8192, 2])
def test_pairs_by_fingerprint(spark, run_rows):
    """Pairs of nodes connect what links of two bits connect, for nodes with several fingerprints too."""
    rnd = random.Random(13)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = base + [x ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for x in base for _ in range(3)]
    marked = sorted({(i % 70, x) for i, x in enumerate(fps)} | {(100 + i, x) for i, x in enumerate(base[:5])})
    signed = [(n, x - (1 << 64) if x >> 63 else x) for n, x in marked]
    got = simhash.linked_texts(spark.createDataFrame(signed, "node long, fp long"), 2, run_rows).collect()
    want = {(min(n, m), max(n, m)) for n, x in marked for m, y in marked if n != m and (x ^ y).bit_count() <= 2}

    def groups(pairs):
        at = {n: n for n, _ in marked}
        for _ in at:
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert groups(got) == groups(want) and len(set(groups(want).values())) < 25
    assert all(a < b for a, b in got)


def test_files_go_by_documents(spark, monkeypatch):
    """However many partitions a shuffle has, a small table's steps are written in few files, each of which costs processes."""
    from folioscope.llm import components

    rnd = random.Random(14)
    texts = []
    for _ in range(30):
        base = prose(rnd, 120)
        texts += [" ".join(base), scattered(rnd, base, 2), " ".join(prose(rnd, 120))]
    files, plain = [], simhash.stored

    def stored(*args):
        out = plain(*args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    monkeypatch.setattr(components, "stored", stored)
    options = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        assert kept(spark, texts) == brute(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 8 and max(files) <= spark.sparkContext.defaultParallelism
