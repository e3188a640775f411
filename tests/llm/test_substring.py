import hashlib
import random
import re

from deducta.llm import substring as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    """Removed words of each (id, text), by the definition."""
    holders = {}
    for i, t in texts:
        w = WORD.findall(t or "")
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                holders[k] = min(i, holders.get(k, i))
    out = []
    for i, t in texts:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and holders[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def cases():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    make = lambda n: [word() for _ in range(n)]
    shared, long = make(60), make(200)
    texts = [(10, " ".join(make(30) + shared + make(30))), (4, " ".join(make(80) + shared)), (20, " ".join(shared + make(10) + shared)), (21, " ".join(make(5) + shared[5:54] + make(5)))]
    texts += [(22, " ".join(make(3) + shared[5:55] + make(3))), (30, " ".join(long)), (31, " ".join(long)), (32, "  " + "\n".join(long)), (33, " ".join(long[20:90] + long[10:90])), (34, " ".join(make(40))), (35, None), (36, ""), (37, " ".join(make(49)))]
    texts += [(40, "a " * 120), (41, "a " * 70), (42, "a " * 49), (43, " ".join(long[:120] + ["x"] + long[121:])), (43, " ".join(long[:120] + ["x"] + long[121:])), (None, " ".join(long))]
    texts += [(100 + i, " ".join(make(20) + shared + make(20))) for i in range(15)]
    return texts


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(200):
        parts = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(3)]
        tokens = [t for p in parts for t in (*p, None)]
        text = [rng.randrange(3) for _ in range(15)]
        strings = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want = [max([n for n in range(1, e + 1) if tuple(text[e - n : e]) in strings], default=0) for e in range(1, 16)]
        assert list(S.SuffixAutomaton(tokens).statistics(text)) == want


def test_equal_windows_share_an_anchor():
    rng = random.Random(3)
    from deducta.llm.common import word_hashes

    for _ in range(50):
        shared = [str(rng.random()) for _ in range(50)]
        a, b = ([str(rng.random()) for _ in range(rng.randrange(60))] + shared + [str(rng.random()) for _ in range(rng.randrange(60))] for _ in range(2))
        x, y = S.anchors(word_hashes(a, {})), S.anchors(word_hashes(b, {}))
        assert set(x.tolist()) & set(y.tolist())


def test_dedup_is_that_of_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, n_words string")
    out = S.dedup(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in out.collect()), key=key)
    assert got == sorted(brute(texts), key=key)


def test_query(spark, tmp_path):
    texts = cases()
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = sorted((tuple(r) for r in S.op6_substring(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(((i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in brute(texts)), key=key)


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_and_parts_of_any_size_agree(spark, monkeypatch):
    """Small shards, each streamed in many parts, and a text of megabytes."""
    monkeypatch.setattr(S, "SHARD_WINDOWS", 7)
    monkeypatch.setattr(S, "RUN_WORDS", 90)
    texts = [*cases(), (500, "b" * 2_000_000), (501, " ".join(f"x{i % 777}" for i in range(60_000)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed) for r in S.dedup(df).collect())
    assert got == sorted(((i is None, i or 0), n, gone) for i, n, gone, _ in brute(texts))
