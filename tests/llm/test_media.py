import hashlib
import zlib

import numpy as np
import pytest

from deducta.llm import media as M


def payloads():
    rng = np.random.default_rng(0)
    walk = (np.cumsum(rng.integers(-2, 3, 6000)) % 256).astype(np.uint8).tobytes()
    sine = (128 + 100 * np.sin(np.arange(9000) / 9)).astype(np.uint8).tobytes()
    return [M.pad(x) for x in (b"", b"a" * 5000, rng.integers(0, 256, 4000, dtype=np.uint8).tobytes(), sine, bytes(range(256)) * 10, b"hello world " * 300, walk)]


def test_round_trip_seek_and_scan():
    own = payloads()
    streams = M.encode(own)
    assert M.decode_many(streams) == own
    for p, s in zip(own, streams, strict=True):
        assert M.seek(s, 1100, 2000) == p[1100:3100] and M.seek(s, len(p) - 16, 16) == p[-16:] and M.seek(s, len(p), 5) == b""
    assert len(streams[3]) < len(own[3]) / 2
    s = streams[3]  # without its seek table
    at = 4 + 4 + 34
    n = int.from_bytes(s[at + 1 : at + 4], "big")
    assert M.decode(s[:4] + bytes([0x80]) + s[5:at] + s[at + 4 + n :]) == own[3]


def test_damage_is_found():
    (s,) = M.encode([payloads()[5]])
    for at in (len(s) - 40, len(s) - 1, len(s) // 2):
        with pytest.raises((ValueError, IndexError)):
            M.decode(s[:at] + bytes([s[at] ^ 4]) + s[at + 1 :])
    with pytest.raises(ValueError):
        M.decode(b"RIFF")


def bits_of(frame_body: str, n: int) -> bytes:
    """A one-frame stream with a hand-written subframe."""
    head = bytes([0xFF, 0xF8, 0x70 | 4, 2, 0]) + (n - 1).to_bytes(2, "big")
    crc8 = int(M._crc_many(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), 8)[0])
    body = head + bytes([crc8]) + int(frame_body.ljust(-(-len(frame_body) // 8) * 8, "0"), 2).to_bytes(-(-len(frame_body) // 8), "big")
    crc16 = int(M._crc_many(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), 16)[0])
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\x00\x00\x22" + info + body + crc16.to_bytes(2, "big")


def rice(values, k):
    out = ""
    for v in values:
        z = 2 * v if v >= 0 else -2 * v - 1
        out += "0" * (z >> k) + "1" + (format(z & ((1 << k) - 1), f"0{k}b") if k else "")
    return out


@pytest.mark.parametrize("order", range(5))
def test_fixed_predictors_of_every_order_with_partitions_and_escapes(order):
    x = [int(v) for v in np.random.default_rng(order).integers(-9, 10, 32)]
    residual = np.diff(np.array(x), n=order).tolist()
    body = f"0{8 + order:06b}0"
    body += "".join(format(v & 255, "08b") for v in x[:order]) + "00" + "0001"
    first, second = residual[: 16 - order], residual[16 - order :]
    body += "0010" + rice(first, 2) + "1111" + f"{9:05b}" + "".join(format(v & 511, "09b") for v in second)
    assert M.decode(bits_of(body, 32)) == bytes(v + 128 for v in x)


def test_linear_predictor():
    x = [3, 5, 8, 12, 11, 9, 4, 0, -3, -2, 0, 1, 1, 2, 5, 7]
    factors, shift = [7, -3], 2
    residual = [x[t] - ((factors[0] * x[t - 1] + factors[1] * x[t - 2]) >> shift) for t in range(2, 16)]
    body = f"0{32 + 1:06b}0" + "".join(format(v & 255, "08b") for v in x[:2]) + f"{5 - 1:04b}" + f"{shift:05b}" + "".join(format(f & 31, "05b") for f in factors) + "00" + "0000" + "0011" + rice(residual, 3)
    assert M.decode(bits_of(body, 16)) == bytes(v + 128 for v in x)


def test_columns(spark):
    texts = ["", None, "héllo", "x" * 5000, "héllo"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, pcm int")
    coded = M.encode_column(df)
    rows = {r.doc_id: r for r in M.describe(coded).collect()}
    for i, t in enumerate(texts):
        p = M.pad((t or "").encode())
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert rows[2].media_sha256 == rows[4].media_sha256 and rows[2].feature == rows[4].feature
    blocks = M.pcm_blocks(coded.select("doc_id", "media")).filter("doc_id = 3").orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == M.pad(b"x" * 5000) and [b.first_sample for b in blocks] == [0, 1152, 2304, 3456, 4608]
    broken = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert all(r.error for r in M.pcm_blocks(broken).collect())
    assert M.describe(M.encode_column(df.limit(0))).count() == 0


def test_streams_do_not_depend_on_groups_of_frames(monkeypatch, spark):
    own = [*payloads(), M.pad(b"a long text " * 200_000), b""]
    streams = M.encode(own)
    found = M.describe(spark.createDataFrame([(i, s) for i, s in enumerate(map(bytearray, streams))], "i long, media binary")).orderBy("i").collect()
    assert [(r.payload_bytes, r.feature) for r in found] == [(len(p), M.features(p)) for p in own]
    for size in (1152, 3000, 20_000):
        monkeypatch.setattr(M, "BATCH_SAMPLES", size)
        assert M.encode(own[:-2]) == streams[:-2] and M.decode_many(streams[:-2]) == own[:-2]
    blocks = [(i, n, first, len(x)) for i, n, first, x in M.read_blocks(streams[:3])]
    assert blocks == [(i, n, n * 1152, min(1152, len(own[i]) - n * 1152)) for i in range(3) for n in range(-(-len(own[i]) // 1152))]


def test_very_long_streams_have_longer_frames(monkeypatch):
    monkeypatch.setattr(M, "MOST_SEEK", 3)
    own = payloads()
    streams = M.encode(own)
    assert M.decode_many(streams) == own and {M.Stream(s).block for s in streams} >= {1152, 4608}
    assert all(M.seek(s, 1100, 2000) == p[1100:3100] for p, s in zip(own, streams, strict=True))
