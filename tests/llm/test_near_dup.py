import random

import numpy as np

from deducta.llm import near_dup as N

from ..conftest import rows

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(5000)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(t, edits):
    w = t.split()
    for _ in range(edits):
        w[RNG.randrange(len(w))] = RNG.choice(VOCABULARY)
    return " ".join(w)


def words(t):
    return N.word_hashes(N.WORD.findall(t or ""), {})


def edits(a, b):
    """By full dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_is_that_of_dynamic_programming():
    for n in range(400):
        few = RNG.choice([2, 4, 5000])
        a = [RNG.randrange(few) for _ in range(RNG.randrange(1, 60))]
        b = list(a)
        for _ in range(RNG.randrange(12)):
            at = RNG.randrange(len(b) + 1)
            b[at : at + RNG.randrange(2)] = [RNG.randrange(few)] * RNG.randrange(2)
        if n % 5 == 0 and len(a) > 20:  # moved piece
            b = b[5:12] + b[:5] + b[12:]
        d = edits(a, b)
        assert N.similar(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == (5 * d <= max(len(a), len(b)))
        x, y = sorted((a, b), key=len, reverse=True)
        for k in {len(x) - len(y), 3, 9, 30}:
            if 0 < k < len(x) and k >= len(x) - len(y) and y:
                assert N.distance(x, y, k) == min(d, k + 1)


def test_long_texts_are_aligned_in_a_narrow_band():
    a = np.arange(200_000, dtype=np.uint64)
    b = a.copy()
    b[::1000] = 7
    assert N.similar(a, np.delete(b, 5)) and not N.similar(a, a[::-1].copy())


def test_shingles_are_labelled_by_occurrence():
    found = N.shingles(words("a b c d e a b c d e a b c d e"))
    assert len(set(found.tolist())) == len(found) == 11
    assert len(N.shingles(words("a b"))) == 1 and N.shingles(words("a b")).tolist() == N.shingles(words(" a\tb\n")).tolist() and len(N.shingles(words(""))) == 1


def test_samples_agree_as_they_should():
    a = text(300)
    b = edited(a, 6)
    x, y = N.shingles(words(a)), N.shingles(words(b))
    j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    same = (N.sample(x, *N.LONG, 0) == N.sample(y, *N.LONG, 0)).mean()
    assert abs(same - j ** N.LONG[1]) < 0.25
    assert (N.sample(x, *N.LONG, 0) == N.sample(N.shingles(words(text(300))), *N.LONG, 0)).sum() == 0


def brute(texts):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    lists = {i: words(t) for i, t in texts}
    for i, t in texts:
        for j, u in texts:
            if i < j and ((t or "") == (u or "") or N.similar(lists[i], lists[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {(i, root(i)) for i, _ in texts}


def test_classes_are_those_of_brute_force(spark):
    texts, n = [], 0
    for size in (5, 9, 30, 60, 150, 400):
        for _ in range(4):
            t = text(size)
            for e in (0, 0, 1, 1, 2, size // 20, size // 12, size // 2):
                texts.append((n, edited(t, e if size > 9 else 0) if e else t))
                n += 1
    texts += [(n, ""), (n + 1, None), (n + 2, "x y"), (n + 3, "x  y"), (n + 4, "x z"), (n + 5, "Z" * 3_000_000), (n + 6, "Z " * 100_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ids = df.selectExpr("doc_id", "unhex(md5(coalesce(text, ''))) tid")
    got = rows(ids.join(N.near_duplicates(df), "tid").select("doc_id", "class_id"))
    assert got == brute(texts)


def test_planted_copies_are_found_at_the_threshold_and_above(spark):
    """Of pairs whose words differ in one of ten nearly all meet; of those at 0.85, nine of ten."""
    for share, least in ((0.1, 0.98), (0.15, 0.88)):
        texts = []
        for i in range(150):
            t = text(200)
            w = t.split()
            for at in RNG.sample(range(200), int(200 * share)):
                w[at] = f"other{i}-{at}"
            texts += [(2 * i, t), (2 * i + 1, " ".join(w))]
        found = N.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
        assert found.filter("class_id < first_id").count() >= least * 150
        assert found.filter("class_id < first_id - 1").count() == 0


def test_a_large_group_and_blocks_that_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_TEXTS", 8)
    t = text(150)
    texts = [(i, edited(t, i % 8)) for i in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ids = df.selectExpr("doc_id", "unhex(md5(text)) tid")
    assert rows(ids.join(N.near_duplicates(df), "tid").select("doc_id", "class_id")) == brute(texts)


def test_keep_one_with_ties_nulls_and_other_columns(spark):
    t = text(60)
    data = [(3, t, "a"), (1, t, "b"), (1, t, "b"), (2, text(60), "c"), (None, "only here and nowhere else at all", "d"), (None, "only here and nowhere else at all", "d"), (5, None, "e"), (6, "", "f")]
    df = spark.createDataFrame(data, "doc_id long, text string, class_id string")
    out = N.keep_one(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.class_id) for r in out.collect()) == [(0, "d"), (1, "b"), (2, "c"), (5, "e")]
    assert N.keep_one(df.limit(0)).count() == 0
