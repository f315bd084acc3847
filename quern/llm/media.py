"""AVI motion-JPEG columns: write and parse RIFF, decode intra frames, detect shots.

A frame is a baseline grey JPEG. ``store`` keeps bytes without loss by making each
byte the size-8 amplitude of one quantised DCT coefficient (64 to a block): with
one-symbol Huffman tables and a restart after each block, every coefficient is a
zero bit and the byte's eight bits. ``read_frame`` decodes any baseline grey JPEG;
frames written here take a vectorised way.

Defined results: null and empty payloads are one block of zeros; equal payloads
give equal files. Rows are independent of each other, of doc_id, which may be null or
repeated, and of other columns, whatever their names. A very long text is one file
(RIFF sizes have 32 bits, which hold any text that fits a row); an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_block, map_arrow, table

#: Width and height of a frame, frames a second.
SIDE, FPS = 32, 25
BLOCKS = (SIDE // 8) ** 2
BINS = 32
#: Shots: frames looked back on, standard deviations over their mean, and the least difference that can be a cut.
LOOK_BACK, DEVIATIONS, FLOOR = 8, 3.0, 0.25


def _zigzag() -> np.ndarray:
    """Scan position to row-major position, walking the anti-diagonals in turn."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _inverse_dct() -> np.ndarray:
    """64 x 64: row-major coefficients to row-major samples."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(one, one).astype(np.float32)


INVERSE = _inverse_dct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    one = bytes([1] + [0] * 15)
    return b"\xff\xd8" + b"".join(
        (
            _segment(0xDB, b"\0" + bytes([1] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + one + b"\x08"),
            _segment(0xC4, b"\x10" + one + b"\x08"),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


HEADER = _header()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def scans(payload: bytes) -> list[bytes]:
    """Entropy-coded data of each frame; the last is filled up with zero bytes."""
    per = BLOCKS * 64
    n = max(1, -(-len(payload) // per))
    raw = np.zeros(n * per, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    bits = np.zeros((n * per, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(raw).reshape(-1, 8)
    code = np.packbits(bits.reshape(-1))
    block = np.repeat(np.arange(n * BLOCKS), 72)
    stuffed = code == 0xFF
    at = np.arange(len(code)) + np.concatenate([[0], np.cumsum(stuffed)[:-1]]) + 2 * (block - block // BLOCKS)
    ends = at[71::72] + 1 + stuffed[71::72]
    out = np.zeros(int(ends[-1]), np.uint8)
    out[at] = code
    marked = np.arange(n * BLOCKS) % BLOCKS != BLOCKS - 1
    out[ends[marked]] = 0xFF
    out[ends[marked] + 1] = 0xD0 + (np.arange(n * BLOCKS) % BLOCKS % 8)[marked]
    cuts = np.concatenate([[0], ends[BLOCKS - 1 :: BLOCKS]])
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def store(payload: bytes) -> bytes:
    """An AVI file that holds the payload."""
    frames = [HEADER + s + b"\xff\xd9" for s in scans(payload)]
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload))
    parts, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(_chunk(b"00dc", f))
        at += len(parts[-1])
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Movie:
    frames: list[bytes]
    seconds_per_frame: float
    payload_bytes: int | None
    width: int
    height: int


def parse(data: bytes) -> Movie:
    """Frames of an AVI file by its index, or in the order of the movie list where it has none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    lists: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                lists.setdefault(kind, (at + 8, at + 8 + n))
                if kind != b"movi":
                    walk(at + 12, at + 8 + n)
            else:
                found.setdefault(name, (at + 8, n))
            at += 8 + n + n % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    head = struct.unpack_from("<14I", data, found[b"avih"][0])
    movi, end = lists[b"movi"]
    frames = []
    if b"idx1" in found:
        at, n = found[b"idx1"]
        entries = list(struct.iter_unpack("<4sIII", data[at : at + n // 16 * 16]))
        origin = 0 if entries and entries[0][2] >= movi else movi
        for name, _, offset, size in entries:
            if name[2:] in (b"dc", b"db"):
                frames.append(data[origin + offset + 8 : origin + offset + 8 + size])
    else:
        at = movi + 4
        while at + 8 <= end:
            n = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + n])
            at += 8 + n + n % 2
    note = None
    if b"ICMT" in found:
        at, n = found[b"ICMT"]
        m = re.match(rb"payload=(\d+)", data[at : at + n])
        note = int(m[1]) if m else None
    return Movie(frames, head[0] / 1e6, note, head[8], head[9])


@dataclass
class _Jpeg:
    width: int
    height: int
    quantiser: np.ndarray
    tables: dict[int, tuple[list[int], bytes]]
    restart: int
    ids: tuple[int, int]
    scan: bytes


def _markers(data: bytes) -> _Jpeg:
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, tuple[list[int], bytes]] = {}
    at, restart, width, height, use = 2, 0, 0, 0, 0
    while True:
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = (counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            if body[5] != 1:
                raise ValueError("only grey frames are decoded")
            use = body[8]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDA:
            end = data.rfind(b"\xff\xd9")
            return _Jpeg(width, height, quant[use], tables, restart, (body[2] >> 4, 16 | body[2] & 15), data[at : end if end >= at else len(data)])


def _fixed(j: _Jpeg) -> np.ndarray | None:
    """Coefficients of frames as ``store`` writes them: every code one bit long and of size 8."""
    one = ([1] + [0] * 15, b"\x08")
    n = -(-j.width // 8) * -(-j.height // 8)
    if j.restart != 1 or any(j.tables.get(t) != one for t in j.ids):
        return None
    raw = np.frombuffer(j.scan, np.uint8)
    after = (raw[:-1] == 0xFF).nonzero()[0] + 1
    keep = np.ones(len(raw), bool)
    keep[after] = False
    marked = after[raw[after] != 0]
    keep[marked - 1] = False
    code = raw[keep]
    if len(code) != n * 72:
        return None
    bits = np.unpackbits(code).reshape(-1, 9)
    if bits[:, 0].any():
        return None
    v = np.packbits(bits[:, 1:]).astype(np.int32)
    return np.where(v < 128, v - 255, v).reshape(n, 64)


def _huffman(j: _Jpeg) -> np.ndarray:
    """Coefficients of any baseline scan of one component."""
    books = []
    for t in j.ids:
        counts, symbols = j.tables[t]
        code, k, book = 0, 0, {}
        for length, c in enumerate(counts, 1):
            for _ in range(c):
                book[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        books.append(book)
    parts = re.split(rb"\xff[\xd0-\xd7]", j.scan) if j.restart else [j.scan]
    n = -(-j.width // 8) * -(-j.height // 8)
    out = np.zeros((n, 64), np.int32)
    b = 0
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        at = dc = 0

        def symbol(book: dict) -> int:
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code * 2 + bits[at]
                at += 1
                if (length, code) in book:
                    return book[length, code]
            raise ValueError("no such code")

        def amplitude(size: int) -> int:
            nonlocal at
            v = 0
            for _ in range(size):
                v = v * 2 + bits[at]
                at += 1
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(j.restart or n, n - b)):
            dc += amplitude(symbol(books[0]))
            out[b, 0] = dc
            k = 1
            while k < 64:
                rs = symbol(books[1])
                if rs == 0:
                    break
                k += rs >> 4
                if rs & 15:
                    out[b, k] = amplitude(rs & 15)
                k += 1
            b += 1
    return out


def read_frame(data: bytes) -> tuple[np.ndarray, _Jpeg]:
    """Quantised coefficients of each block in scan order."""
    j = _markers(data)
    fixed = _fixed(j)
    return (_huffman(j) if fixed is None else fixed), j


def samples(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Grey samples of each block, 0 to 255."""
    plain = np.zeros(coefficients.shape, np.float32)
    plain[:, ZIGZAG] = coefficients * quantiser
    return np.clip(np.rint(plain @ INVERSE + 128), 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> np.ndarray:
    """Frames that begin a shot.

    The first does; another does if its histogram differs from the one before by
    more than the mean plus DEVIATIONS standard deviations of the last LOOK_BACK
    differences, and by more than FLOOR (half the summed absolute difference, 0 to 1).
    """
    n = len(histograms)
    share = histograms / np.maximum(1, histograms.sum(1, keepdims=True))
    d = np.abs(np.diff(share, axis=0)).sum(1) / 2
    sums = np.concatenate([[0], np.cumsum(d)])
    squares = np.concatenate([[0], np.cumsum(d * d)])
    hi = np.arange(n - 1)
    lo = np.maximum(0, hi - LOOK_BACK)
    m = np.maximum(1, hi - lo)
    mean = (sums[hi] - sums[lo]) / m
    var = np.maximum(0, (squares[hi] - squares[lo]) / m - mean * mean)
    cut = d > np.maximum(FLOOR, mean + DEVIATIONS * np.sqrt(var))
    return np.concatenate([[0], np.nonzero(cut)[0] + 1])[: max(1, n)]


def analyse(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, Movie]:
    """Bytes that ``store`` put into a file, its frames' histograms, the shots' first frames, and the file's parts."""
    movie = parse(data)
    kept, hists = [], []
    for f in movie.frames:
        c, j = read_frame(f)
        kept.append(np.where(c < 0, c + 255, c))
        hists.append(np.bincount(samples(c, j.quantiser).reshape(-1) >> 3, minlength=BINS))
    raw = np.concatenate(kept).astype(np.uint8).tobytes() if kept else b""
    h = np.array(hists) if hists else np.zeros((0, BINS))
    return raw[: movie.payload_bytes] if movie.payload_bytes is not None else raw, h, shots(h) if len(h) else np.zeros(0, int), movie


def clips(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Timed clip rows of a column of AVI files: one row for each shot."""
    kind = df.schema[key].dataType.simpleString()

    def work(keys: list, files: list) -> pa.RecordBatch:
        rows = []
        for k, f in zip(keys, files, strict=True):
            if f is None:
                continue
            _, h, starts, movie = analyse(f)
            for i, (a, b) in enumerate(zip(starts.tolist(), [*starts.tolist()[1:], len(h)], strict=True)):
                rows.append((k, i, a * movie.seconds_per_frame, b * movie.seconds_per_frame, b - a, float(h[a:b].sum(0) @ np.arange(BINS) / max(1, h[a:b].sum())) * 256 / BINS))
        names = [key, "clip", "start_s", "end_s", "n_frames", "mean_level"]
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows]) if rows else None

    return map_arrow(df.select(key, media), by_block([key, media], work), f"`{key}` {kind}, clip long, start_s double, end_s double, n_frames long, mean_level double")


def padded(text: str | None) -> tuple[bytes, bytes]:
    """The UTF-8 bytes of a text, and those filled with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw, raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def _features(hists: np.ndarray, starts: np.ndarray, movie: Movie) -> str:
    total = hists.sum(0)
    level = float(total @ np.arange(BINS)) / max(1, total.sum())
    times = ",".join(f"{s * movie.seconds_per_frame:.2f}" for s in starts.tolist())
    return f"frames={len(hists)};shots={len(starts)};level={level:.4f};hist={zlib.crc32(total.astype('<i8').tobytes()):08x};starts={times}"


def documents_as_media(df: DataFrame) -> DataFrame:
    """Store each text as an AVI file, read the file back, and describe both.

    Everything happens where the row is read: no shuffle, one file in memory at a time.
    """

    def work(keys: list, texts: list) -> pa.RecordBatch:
        rows = []
        for k, t in zip(keys, texts, strict=True):
            raw, payload = padded(t)
            data = store(payload)
            back, hists, starts, movie = analyse(data)
            rows.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), _features(hists, starts, movie)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=NAMES)

    return map_arrow(df.select("doc_id", "text"), by_block(["doc_id", "text"], work), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op5_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through an AVI file."""
    return documents_as_media(table(spark, sf_dir, "documents"))
