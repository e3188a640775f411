import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deducta.llm import pitman_yor as P

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    return {r.doc_id: r for r in P.op3_pitman_yor(spark, sf_dir).collect()}


def test_counts_and_base(scored, spark, sf_dir):
    docs = {r.doc_id: WORD.findall((r.text or "").encode().lower()) + [b""] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    c = Counter(w for i, t in docs.items() if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    assert scored.keys() == docs.keys()
    for i, t in docs.items():
        r = scored[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))


def test_it_predicts_better_than_the_base(scored):
    for side in (True, False):
        own = [r for r in scored.values() if r.held_out == side]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert all(r.score <= 0 for r in scored.values())


def small_seating(seed=0):
    rng = np.random.default_rng(seed)
    words, contexts = 30, np.array([5, 7, 21, 37, 16 * 9, 16 * 9 + 3])
    pairs = np.array([(w, c) for w in range(words) for c in sorted(contexts) if rng.random() < 0.4])
    return P.Seating(words, pairs[:, 0], pairs[:, 1], rng.integers(1, 400, len(pairs)) // rng.integers(1, 200, len(pairs)) + 1), contexts


def test_predictions_sum_to_one():
    seating, contexts = small_seating()
    totals, d, base = seating.totals(), [0.5, 0.6, 0.7], 1 / 31
    for own in P.chain(seating, 3, 1, totals, d, base):
        exact = own.totals()
        assert (own.tables >= 1).all() and (own.tables <= own.count).all() and (own.count1 == np.bincount(own.up, weights=own.tables)).all()
        for c in [*contexts, 999]:
            p = own.predict(exact, d, base, np.arange(30), np.full(30, c))
            # the missing word has what is left to the base
            p0 = (P.STRENGTH[0] + d[0] * exact.root[1]) * base / (P.STRENGTH[0] + exact.root[0])
            j = c // P.PER_PARENT
            p1 = (P.STRENGTH[1] + d[1] * exact.parents[1][j]) * p0 / (P.STRENGTH[1] + exact.parents[0][j])
            rest = (P.STRENGTH[2] + d[2] * exact.contexts[1][c]) * p1 / (P.STRENGTH[2] + exact.contexts[0][c])
            assert p.sum() + rest == pytest.approx(1)


def test_chains_repeat():
    runs = [[own.tables.copy() for own in P.chain(s, 1, 2, s.totals(), [0.5] * 3, 0.01)] for s in (small_seating(1)[0], small_seating(1)[0])]
    assert len(runs[0]) == P.SAMPLES and all((a == b).all() for a, b in zip(*runs, strict=True))


def test_seating_has_the_right_mean():
    """Against seating customers one at a time."""
    rng, d, pull, n = np.random.default_rng(0), 0.6, 1.5, 200
    got = P.reseat(np.full(4000, n), np.full(4000, pull), d, rng).mean()
    want = []
    for _ in range(400):
        t = 1
        for i in range(1, n):
            t += rng.random() < pull / (i - d * t + pull)
        want.append(t)
    assert got == pytest.approx(np.mean(want), rel=0.06)


def test_edge_cases(spark):
    data = [(None, "A b", True), (1, None, True), (1, "", False), (2, "a B a b", True), (2, "a B a b", True), (3, "zzz " * 300, False)]
    df = spark.createDataFrame(data, "doc_id long, text string, train boolean")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, round(r.score, 6)) for r in P.score(df, "train", ["doc_id"], block_chars=5).collect()), key=str)
    assert len(got) == 6 and got[3] == got[4] or got[2] == got[3]
    assert all(r.train_tokens == 14 for r in P.score(df, "train", ["doc_id"]).collect())
    none = P.score(df.selectExpr("doc_id", "text", "false as train"), "train", ["doc_id"]).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in none)
    assert P.score(df.limit(0), "train", ["doc_id"]).count() == 0


def test_perplexity(spark):
    df = spark.createDataFrame([(True, 2, -2.0, -4.0), (True, 2, -2.0, -4.0)], "held_out boolean, n_tokens long, score double, base_score double")
    r = P.perplexity(df, "held_out").first()
    assert r.perplexity == pytest.approx(10) and r.base_perplexity == pytest.approx(100)


def test_words_with_one_ending_are_contexts_of_their_own(spark):
    """What follows a word is learned from that word, not from others that end alike."""
    pairs = {f"{c}{d}-tail": ("left" if (c, d) < ("k", "a") else "right") for c in "abcdefghijklmnopqrst" for d in "abc"}
    assert len({P.context_of(w.encode()) for w in pairs}) == len(pairs)
    data = [(i, f"{w} {pairs[w]}", True) for i, w in enumerate([*pairs] * 20)]
    data += [(10_000 + i, f"{w} {x}", False) for i, w in enumerate(pairs) for x in ("left", "right")]
    df = spark.createDataFrame(data, "doc_id long, text string, train boolean")
    got = {}
    for r in P.score(df, "train", ["doc_id", "text"]).collect():
        got[r.text] = r.score
    for w, x in pairs.items():
        assert got[f"{w} {x}"] > got[f"{w} {'right' if x == 'left' else 'left'}"] + 0.5


class Plain:
    """The model by the book: every customer sits at a table, is taken up and seated anew, one at a time."""

    def __init__(self, discounts, base, seed):
        self.d, self.base, self.rng = discounts, base, np.random.default_rng(seed)
        self.rooms = {}  # (level, context) -> word -> customers of each table

    def parent(self, level, context):
        return (level - 1, (context[-1:] if context else b"\0") if level == 2 else None)

    def p(self, room, word):
        level, context = room
        above = self.base if level == 0 else self.p(self.parent(level, context), word)
        tables = self.rooms.get(room, {})
        mine, sizes = tables.get(word, []), [n for t in tables.values() for n in t]
        d, s = self.d[level], P.STRENGTH[level]
        return (sum(mine) - d * len(mine) + (s + d * len(sizes)) * above) / (s + sum(sizes))

    def add(self, room, word):
        level, context = room
        above = self.base if level == 0 else self.p(self.parent(level, context), word)
        tables = self.rooms.setdefault(room, {})
        d, s = self.d[level], P.STRENGTH[level]
        mine = tables.setdefault(word, [])
        weights = np.array([n - d for n in mine] + [(s + d * sum(map(len, tables.values()))) * above])
        at = self.rng.choice(len(weights), p=weights / weights.sum())
        if at < len(mine):
            mine[at] += 1
        else:
            mine.append(1)
            if level:
                self.add(self.parent(level, context), word)

    def remove(self, room, word):
        mine = self.rooms[room][word]
        at = self.rng.choice(len(mine), p=np.array(mine) / sum(mine))
        mine[at] -= 1
        if not mine[at]:
            del mine[at]
            if room[0]:
                self.remove(self.parent(*room), word)


def test_score_agrees_with_a_plain_sampler(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}{'abc'[i % 3]}" for i in range(12)]
    texts = [" ".join(words[min(11, int(rng.zipf(1.6)) - 1)] for _ in range(rng.integers(0, 40))) for _ in range(40)]
    train = [i % 4 != 3 for i in range(40)]
    docs = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(texts, train, strict=True))], "id long, text string, train boolean")
    got = {r.id: r.score for r in P.score(docs, "train", ["id"]).collect()}

    pairs = []
    for t in texts:
        tokens = [w.encode() for w in t.split()] + [b""]
        pairs.append(list(zip(tokens, [b"", *tokens[:-1]], strict=True)))
    seen = Counter(x for p, b in zip(pairs, train, strict=True) if b for x in p)
    last = lambda c: c[-1:] or b"\0"
    upper = Counter((w, last(c)) for w, c in seen)
    root = Counter(w for w, _ in upper)
    discounts = [min(0.95, max(0.05, (c1 := sum(n == 1 for n in x.values())) / max(c1 + 2 * sum(n == 2 for n in x.values()), 1))) for x in (root, upper, seen)]
    own = Plain(discounts, 1 / (len({w for w, _ in seen}) + 1), 1)
    customers = [x for p, b in zip(pairs, train, strict=True) if b for x in p]
    for w, c in customers:
        own.add((2, c), w)
    total, sweeps = {x: 0.0 for p in pairs for x in p}, 0
    for sweep in range(14):
        for w, c in customers:
            own.remove((2, c), w)
            own.add((2, c), w)
        if sweep >= 4:
            sweeps += 1
            for w, c in total:
                total[w, c] += own.p((2, c), w)
    want = {i: sum(math.log10(total[x] / sweeps) for x in p) for i, p in enumerate(pairs)}
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.01)
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=0.06, abs=0.15)


def test_entries_are_predicted_once_however_many_blocks_ask(monkeypatch):
    """A bucket's work on answers grows with its distinct entries, not with blocks times entries."""
    words, contexts = [b"", b"one", b"two"], np.array(sorted(P.context_of(w) for w in (b"", b"one", b"two", b"there")))

    def group(blocks):
        rows = []
        for block in range(blocks):
            mine = [words[(block + k) % 3] for k in range(3)]
            n = np.array([1 + (block + k) % 3 for k in range(3)])
            at = np.concatenate([np.array([3, 1, 0])[:k] for k in n])  # not in their order
            counts = np.where(at == 1, 0, 1 + at)  # one is only asked for
            rows.append((block, P.pack_all(np.array([len(w) for w in mine]), n, at, counts, np.diff(contexts, prepend=0)), P.pack_bytes(b"".join(mine)), P.pack(np.arange(3)), mine, n, contexts[at], counts))
        return pa.table({k: list(c) for k, c in zip(("block", "data", "words", "slots"), zip(*(r[:4] for r in rows), strict=True), strict=True)}), rows

    def answers(blocks):
        table, rows = group(blocks)
        model, asked = P._merge(table)
        seating = P._seating(model)
        totals, each, kept, places = seating.totals(), [], [], []
        for own in P.chain(seating, 0, 1, totals, [0.5] * 3, 0.1):
            each.append(own.totals())
            kept.append((own.tables, own.tables1, own.tables0))
        with monkeypatch.context() as patch:
            predict_at = P.Seating.predict_at
            patch.setattr(P.Seating, "predict_at", lambda self, t, d, base, at: (places.append(len(at[0])), predict_at(self, t, d, base, at))[1])
            out = P._answers(seating, model, asked, each, kept, [0.5] * 3, 0.1)
        seen = Counter()
        for r in rows:
            for w, k in zip(np.repeat(r[4], r[5]).tolist(), r[7].tolist(), strict=True):
                seen[w] += k
        number = {w: i for i, w in enumerate(dict.fromkeys(w for r in rows for w in r[4]))}
        for r, (block, data, slots) in zip(rows, out, strict=True):
            known, n, scores = P.unpack_all(data)
            assert (block, slots, known.tolist(), n.tolist()) == (r[0], r[3], [seen[w] for w in r[4]], r[5].tolist())
            total = 0
            for t, tables in zip(each, kept, strict=True):
                seating.put(*tables)
                total = total + seating.predict(t, [0.5] * 3, 0.1, np.repeat([number[w] for w in r[4]], r[5]), r[6])
            assert scores / P.UNIT == pytest.approx(-np.log10(total / len(each)), abs=1e-6)
        return places

    assert answers(3) == answers(30) == [6] * P.SAMPLES


def test_words_end_at_the_same_bytes_as_in_the_contract(spark):
    """Of all bytes below 128, only 32 and 9 to 13 part words; upper-case letters count as lower-case ones."""
    texts = [f"a{chr(i)}B" for i in range(1, 128)] + ["a\u00a0b \u2003\u00c4"]
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in P.score(df, "train", ["doc_id"]).collect()}
    split = [WORD.findall(t.encode().lower()) + [b""] for t in texts]
    known = {w for t in split[::2] for w in t}
    assert got == {i: (len(t), sum(w in known for w in t)) for i, t in enumerate(split)}
