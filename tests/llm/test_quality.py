import zlib

import numpy as np

from deducta.llm import quality as Q


def plain_logit(filters, out, bias, pieces):
    """The network's formula, chunk by chunk and place by place."""
    hop, chunks = Q.CHUNK - Q.OVERLAP, []
    for t in pieces:
        at = 0
        while True:
            x = [*t[at : at + Q.CHUNK]]
            chunks.append(x + [256] * (Q.CHUNK - len(x)))
            if at + Q.CHUNK >= len(t):
                break
            at += hop
    responses = []
    for x in chunks:
        x = np.array(x)
        responses.append(np.tanh(0.5 * np.max([sum(filters[j, x[p + j]] for j in range(Q.WIDTH)) for p in range(Q.CHUNK - Q.WIDTH + 1)], axis=0)))
    return float(np.concatenate([np.mean(responses, axis=0), np.max(responses, axis=0)]) @ out + bias)


def plain_score(net, text):
    return 1 / (1 + np.exp(-plain_logit(net.filters.astype(float), net.out.astype(float), float(net.bias[0]), [text]) - net.offset))


def test_forward_pass_and_gradients_are_those_of_a_plain_version():
    rng = np.random.default_rng(2)
    texts = [[b""], [b"short"], [rng.integers(97, 105, 700, dtype=np.uint8).tobytes()], [rng.integers(97, 105, n, dtype=np.uint8).tobytes() for n in (256, 100)]]
    net = Q.Network(1)
    net.out[:], net.bias[:] = rng.normal(size=len(net.out)), 0.3
    for t in texts[:3]:
        assert abs(net.scores(t)[0] - plain_score(net, t[0])) < 1e-5
    labels = np.array([0, 1, 1, 0], dtype=np.float32)
    chunks, counts = Q.chunked([p for t in texts for p in t])
    got = net.gradients(chunks, np.array([*counts[:3], counts[3:].sum()]), labels)

    def loss(filters, out, bias):
        z = np.array([plain_logit(filters, out, bias, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    w = [net.filters.astype(float), net.out.astype(float), float(net.bias[0])]
    step = 1e-5
    assert abs((loss(w[0], w[1], w[2] + step) - loss(w[0], w[1], w[2] - step)) / (2 * step) - got[2][0]) < 1e-4
    for k in (0, 5, 20):
        e = np.eye(len(w[1]))[k] * step
        assert abs((loss(w[0], w[1] + e, w[2]) - loss(w[0], w[1] - e, w[2])) / (2 * step) - got[1][k]) < 1e-4
    places = np.argwhere(np.abs(got[0]) > 1e-3)[::40][:6]
    assert len(places)
    for at in map(tuple, places):
        e = np.zeros_like(w[0])
        e[at] = step
        assert abs((loss(w[0] + e, w[1], w[2]) - loss(w[0] - e, w[1], w[2])) / (2 * step) - got[0][at]) < 1e-3


def test_long_labelled_texts_teach(spark):
    good, bad = "the and of then " * 4000, "xx*** yy$$$ zz%%% " * 4000
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + str(i), 9) for i in range(24)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2, "k") for i in range(24)] + [(3, None, "k"), (99, 0, "k")], "doc_id long, quality int, text string")
    a, b = Q.fit(docs, labels).scores([good.encode(), bad.encode()])
    assert a > 0.9 and b < 0.1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = Q.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    own = found[found.held_out]
    assert len(own) > 50 and (own.predicted == own.quality).mean() > 0.93
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert ((found.score >= 0.7) == (found.predicted == 1)).all()


def test_every_byte_is_in_a_chunk_and_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    texts = [b"", b"a", rng.integers(0, 256, 256, dtype=np.uint8).tobytes(), rng.integers(0, 256, 257, dtype=np.uint8).tobytes(), rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()]
    chunks, counts = Q.chunked(texts)
    start, hop = 0, Q.CHUNK - Q.OVERLAP
    for t, n in zip(texts, counts.tolist(), strict=True):
        flat = np.concatenate([chunks[start][: Q.OVERLAP], *(c[Q.OVERLAP :] for c in chunks[start : start + n])]) if n else []
        assert bytes(flat[: len(t)].astype(np.uint8)) == t and (flat[len(t) :] == Q.SYMBOLS - 1).all()
        assert all((chunks[start + k][-Q.OVERLAP :] == chunks[start + k + 1][: Q.OVERLAP]).all() for k in range(n - 1)) and hop > 0
        start += n
    net = Q.Network()
    net.out[:] = rng.normal(size=len(net.out))
    together = net.scores(texts)
    assert [net.scores([t])[0] for t in texts] == together.tolist()


def test_the_end_of_a_long_text_counts(spark):
    good, bad = "the and of then " * 40, "xx*** yy$$$ zz%%% " * 40
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + str(i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = Q.fit(docs, labels)
    a, b, c = net.scores([(good * 40).encode(), (good * 20 + bad * 20).encode(), (bad * 40).encode()])
    assert a > 0.9 and c < 0.1 and b < a


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x", 0.1)], "doc_id long, text string, score double")
    none = Q.fit(docs, spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int"))
    got = Q.score(docs, none)
    assert got.columns == ["doc_id", "text", "score"] and len({r.score for r in got.collect()}) == 1
    assert Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int")).scores([b"x"])[0] == 0.5
    both = Q.fit(docs, spark.createDataFrame([(1, 0), (9, 1)], "doc_id long, quality int"))
    assert 0 <= both.scores([b""])[0] <= 1
    assert Q.score(docs.limit(0), none).count() == 0
