import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import media as M

from .helpers import as_tables, edge_docs, edge_rows


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_payload_comes_back(data):
    padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    assert M.analyse(M.store(padded))[0] == padded


def test_stored_frames_decode_alike_both_ways():
    movie = M.parse(M.store(bytes(range(256)) * 9))
    for f in movie.frames:
        j = M._markers(f)
        assert (M._huffman(j) == M._fixed(j)).all()


def _encode(levels: np.ndarray) -> bytes:
    """A baseline frame of flat blocks with the usual kind of tables: DC categories of unequal code length, AC end of block only."""
    counts = [0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7
    symbols = bytes(range(12))
    codes, code, k = {}, 0, 0
    for length, c in enumerate(counts, 1):
        for _ in range(c):
            codes[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    bits, last = "", 0
    for v in (levels.reshape(-1) - 128).tolist():
        d, last = v - last, v
        size = abs(d).bit_length()
        c, n = codes[size]
        bits += f"{c:0{n}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    h, w = (8 * n for n in levels.shape)
    q = bytes([0]) + bytes([8]) + bytes([1] * 63)
    return b"\xff\xd8" + M._segment(0xDB, q) + M._segment(0xC0, struct.pack(">BHHB", 8, h, w, 1) + b"\x01\x11\x00") + M._segment(0xC4, b"\x00" + bytes(counts) + symbols) + M._segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00") + M._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"


def test_general_frames_give_their_samples():
    levels = np.random.default_rng(0).integers(0, 256, (3, 4))
    c, j = M.read_frame(_encode(levels))
    assert (M.samples(c, j.quantiser) == levels.reshape(-1, 1)).all()


def test_zigzag_and_dct_agree_with_the_definition():
    assert M.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    block = np.zeros((1, 64))
    block[0, 2] = 40  # scan position 2: first column frequency
    x = np.arange(8)
    want = 128 + 40 / 4 * np.cos((2 * x + 1) * np.pi / 16) / np.sqrt(2)
    got = M.samples(block, np.ones(64)).reshape(8, 8)
    assert np.abs(got - np.rint(want)[:, None]).max() <= 1


def test_shots_at_changes_only():
    dark, light = np.eye(32)[2] * 100, np.eye(32)[25] * 100
    h = np.array([dark] * 10 + [light] * 10 + [dark] * 5)
    assert M.shots(h).tolist() == [0, 10, 20]
    assert M.shots(np.array([dark] * 30)).tolist() == [0]


def test_clips_are_timed(spark):
    d = spark.createDataFrame([(1, M.store(b"\1" * 4096)), (2, None)], "doc_id long, media binary")
    rows = M.clips(d).collect()
    assert [r.doc_id for r in rows] == [1] and rows[0].start_s == 0 and abs(rows[0].end_s - 4 / M.FPS) < 1e-9


def test_query(spark, tmp_path):
    got = M.op5_media_avi(spark, as_tables(tmp_path, documents=edge_docs(spark))).collect()
    assert len(got) == len(edge_rows())
    by_bytes: dict = {}
    for r in edge_rows():
        raw = (r[1] or "").encode()
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        match = [g for g in got if g.doc_id == r[0] and g.payload_sha256 == hashlib.sha256(pay).hexdigest()]
        assert match and match[0].n_bytes == len(raw) and match[0].payload_bytes == len(pay) and match[0].tail_crc32 == zlib.crc32(pay[-64:])
        by_bytes.setdefault(raw, set()).add((match[0].media_sha256, match[0].feature))
    assert all(len(v) == 1 for v in by_bytes.values())
