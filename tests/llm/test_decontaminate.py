import random

from deducta.llm import decontaminate as D

from ..conftest import rows


def greedy(p, t, least):
    """Greedy string tiling by its definition."""
    free_p, free_t, out = [True] * len(p), [True] * len(t), 0
    while True:
        best, found = 0, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] >= 0 and free_p[i + n] and free_t[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if all(free_p[i : i + best]) and all(free_t[j : j + best]):
                free_p[i : i + best] = free_t[j : j + best] = [False] * best
                out += best


def test_tiles_cover_as_much_as_the_definition():
    rng = random.Random(0)
    for _ in range(300):
        p, t = [rng.randrange(5) for _ in range(rng.randrange(1, 40))], [rng.randrange(-1, 5) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            a = rng.randrange(len(p) + 1)
            t = t + p[a:] + t[:3] + p[:a]
        assert sum(n for *_, n in D.tiles(p, t, 3)) == greedy(p, t, 3)


def test_tiles_cover_as_much_as_the_definition_at_the_least_length_in_use():
    rng = random.Random(2)
    for _ in range(150):
        p = list(range(rng.randrange(10, 40)))
        t = []
        for _ in range(rng.randrange(1, 6)):  # pieces in any order, which overlap
            a = rng.randrange(len(p))
            t += [*p[a : a + rng.randrange(3, 13)], -1]
        assert sum(n for *_, n in D.tiles(p, t, D.LEAST)) == greedy(p, t, D.LEAST)


def test_what_a_longer_tile_leaves_of_a_match_is_tiled(spark):
    p = list(range(20))
    assert sorted(D.tiles(p, [*p[:8], -1, *p[6:15]], D.LEAST)) == [(0, 0, 6), (6, 9, 9)]
    words = [f"w{i}" for i in p]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(7, " ".join([*words[:8], "apart", *words[6:15]]))], "doc_id long, text string")
    assert rows(D.contaminated(docs, bench)) == {(7, 1, 0.75, 2)} and D.clean(docs, bench).count() == 0


def test_contamination(spark):
    rng = random.Random(1)
    make = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    item, other, short = make(40), make(30), make(3)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(short)), (4, None), (5, ""), (1, " ".join(item))], "item_id long, text string")
    filler = lambda n=50: " ".join(make(n))
    texts = {
        1: f"{filler()} {' '.join(item)} {filler()}",
        2: f"{filler()} {' '.join(item[20:])} and {' '.join(item[:20])}",  # reordered
        3: f"{filler()} {' '.join(item[:15])} {filler()}",  # too little
        4: f"{' '.join(item).upper()}! {' '.join(other)}",
        5: filler(300),
        6: f"{filler()} {' '.join(short)}.",
        7: None,
        8: "",
        9: " ".join(x if i % 3 else "other" for i, x in enumerate(item)),  # no run is long enough
        10: " ".join(item) + " " + " ".join(item * 200),
    }
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()], "doc_id long, text string, item_id string")
    got = rows(D.contaminated(docs, bench).select("doc_id", "item_id"))
    assert got == {(1, 1), (2, 1), (4, 1), (4, 2), (6, 3), (10, 1)}
    clean = D.clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {3, 5, 7, 8, 9}
    assert D.clean(docs, bench.limit(0)).count() == len(texts) and D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), bench).count() == 0


def test_a_large_benchmark_goes_in_blocks(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = rows(D.contaminated(docs, bench))
    monkeypatch.setattr(D, "BLOCK_CHARS", 3000)
    assert rows(D.contaminated(docs, bench)) == whole and whole


def test_whole_query_is_that_of_brute_force(spark, tmp_path):
    rng = random.Random(6)
    make = lambda n, few=60: [f"w{rng.randrange(few)}" for _ in range(n)]
    items = [(i, " ".join(make(rng.randrange(0, 30), rng.choice([8, 60, 900])))) for i in range(25)]
    items += [(1, items[1][1]), (70, items[2][1]), (None, items[3][1]), (71, "same " * 30), (72, None), (73, "two words"), (74, "")]
    texts = []
    for i in range(60):
        parts = [make(rng.randrange(15), 900)]
        for _ in range(rng.randrange(4)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [w[a:], make(rng.randrange(3), 900), w[:a]]
        texts.append((i, " ".join(x for p in parts for x in p)))
    texts += [(60, None), (61, ""), (62, "same " * 500), (2, texts[2][1]), (None, texts[3][1])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for i, t in texts:
        for n, x in items:
            p, d = D.tokens(x or ""), D.tokens(t or "")
            codes = {w: c for c, w in enumerate(dict.fromkeys(p))}
            if p and greedy([codes[w] for w in p], [codes.get(w, -1) for w in d], min(D.LEAST, len(p))) >= D.COVERAGE * len(p):
                want.append((i, n))
    key = lambda x: [(v is None, v or 0) for v in x]
    assert sorted(((r.doc_id, r.item_id) for r in D.op4_decontaminate(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key) and want


def test_repeated_tokens_and_items_take_no_square_of_work(spark):
    import time

    start = time.perf_counter()
    assert D.tiles([0] * 400, [0] * 100_000, D.LEAST) == [(0, 0, 400)]
    block = D.Benchmark.of([b"x"], ["again " * 400], D.LEAST)
    assert block.matches(D.word_hashes(["again"] * 100_000, {}), D.COVERAGE) == [(0, 1.0, 1)]
    assert time.perf_counter() - start < 4
    bench = spark.range(100_000).selectExpr("id item_id", "'one item that is there a hundred thousand times' text")
    docs = spark.createDataFrame([(1, "it says one item that is there a hundred thousand times over"), (2, "it says nothing " * 200_000)], "doc_id long, text string")
    assert D.contaminated(docs, bench).count() == 100_000 and {r.doc_id for r in D.clean(docs, bench).collect()} == {2}
