import numpy as np
from pyspark.sql import functions as F

from loomlog.llm import ngram_join
from loomlog.llm.connected import components
from loomlog.llm.ngram_join import keep_one, near_duplicates


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(rng, families=12, copies=14, words=60):
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(words // 2, words))] + (shared if rng.random() < 0.5 else [])
        for _ in range(copies):
            doc = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(doc))
                if rng.random() < 0.5:
                    doc[at] = rng.choice(vocabulary)
                else:
                    del doc[at : at + rng.randint(1, 3)]
            out.append(" ".join(doc))
    out += ["", "  ", "one", "one", "ONE", "one two three", "One  two\tthree", "w1 w2 w3 w4 w5", "w1 w2 w3 w4 w5 w6"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_equals_brute_force(spark, rng, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    rows = corpus(rng)
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == brute(rows)


def test_odd_tables(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    known = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (4, 1, 4), (5, 1, 4), (9, 5, 8), (12, 2, 11), (None, 1, 4), (None, 0, None)} <= known
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and 5 not in {r.doc_id for r in kept.collect()}
    assert near_duplicates(no_docs).count() == 0 == keep_one(no_docs).count()


def test_other_thresholds(spark, rng):
    rows = corpus(rng, 4, 6)
    got = {r[0]: r[2] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=100).collect()}
    sets = {}
    for i, t in rows:
        s = frozenset(shingle_set(t))
        assert got[i] == (sets.setdefault(s, i) if s else i)


def test_components_of_paths_and_stars(spark):
    path, star = [(k, k + 1) for k in range(100, 140)], [(7, k) for k in range(1, 7)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 1 for k in range(1, 8)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bound_on_shared_tokens_never_loses_a_link(spark):
    """For all sizes and overlaps that make a link, the tokens shared between prefixes reach the bound."""
    rng = np.random.default_rng(3)
    cases = []
    for _ in range(400):
        n, m = rng.integers(1, 60, 2)
        need = -(-75 * int(n + m) // 175)
        if need > min(n, m):
            continue
        both = rng.permutation(200)
        a, b = set(both[:n]), set(both[n - need : n - need + m])
        cut = lambda s: set(sorted(s)[: len(s) - (75 * len(s) + 99) // 100 + 1])
        cases.append((int(n), int(m), len(cut(a) & cut(b))))
    rows = spark.createDataFrame(cases, "n long, m long, shared long").withColumn("least", ngram_join.fewest_shared(F.col("n"), F.col("m"), F.col("m"), 75))
    assert rows.where("shared < least").count() == 0


def test_near_copies_of_one_text_cost_in_proportion(spark, rng, monkeypatch):
    """The sets that move for N near copies are a few times N, not N * N / BLOCK."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "NEAR", 8)
    moved, materialize = [], ngram_join.materialize

    def counted(df, name="table"):
        out = materialize(df, name)
        if name == "roles":
            moved.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        at = rng.randrange(120)
        rows.append((i, " ".join(base[:at] + [f"own{i}"] + base[at + 1 :])))
    got = {r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0} and 300 <= sum(moved) <= 1200


def test_blocks_hold_sets_of_like_sizes(spark):
    """A wide range of sizes lets one chance token open a block; within a tenth, the bound follows from the sizes."""
    labels = spark.range(1, 400).selectExpr("id AS doc", "id AS n", "id AS m1", "1L AS label")
    nodes = spark.createDataFrame([(k, 7) for k in range(7, 20)], "node long, component long")
    blocks = ngram_join.grouped(labels, nodes).groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    assert blocks.where("high > 1.1 * low + 1").count() == 0 and blocks.count() < 80


def test_tokens_of_few_and_of_many_documents_agree(monkeypatch):
    """Taken pair by pair or document by group, every pair of different clusters whose sizes fit is met from one side."""
    import pandas as pd

    rng = np.random.default_rng(5)
    rows = {(int(t), int(d)) for t, d in zip(rng.integers(0, 40, 700), rng.integers(0, 90, 700))}
    n, cluster, block = rng.integers(10, 60, 90), rng.integers(0, 30, 90), rng.integers(0, 12, 90)
    family = np.bincount(block, minlength=12)[block]
    frame = pd.DataFrame([(t, d, n[d], cluster[d], block[d], family[d]) for t, d in sorted(rows)], columns=["token", "doc", "n", "cluster", "block", "family"])
    for few in (2, 16, 64):
        monkeypatch.setattr(ngram_join, "FEW", few)
        met = {(q, b): s for q, b, s in ngram_join.candidates(frame, 75).itertuples(index=False)}
        for x in range(90):
            for y in range(x):
                both = len({t for t, d in rows if d == x} & {t for t, d in rows if d == y})
                if both and cluster[x] != cluster[y] and 100 * min(n[x], n[y]) >= 75 * max(n[x], n[y]):
                    assert max(met.get((x, block[y]), 0), met.get((y, block[x]), 0)) >= both
