"""Media columns: motion-JPEG in AVI. RIFF index, intra frames, shots by adaptive histogram differences, clip rows.

Avi finds the video chunks through idx1 (or, without one, by walking movi). decode() decodes a baseline JPEG: Huffman
tables, restart intervals, 4:2:0 and other samplings, dequantisation and inverse DCT; with scale 8 it keeps each
block's DC term only, which is the frame at an eighth of its size. A reader takes the bits in one pass. Frames of one
component whose blocks have no other term than the DC are read side by side as arrays, from any Huffman tables: the
length of a block is looked up at every bit place at once, and the chains of blocks are followed in step (flat()); a
frame that has other terms is left to the reader. shots() cuts where the difference of consecutive luma histograms
exceeds the mean of the last WINDOW differences by SIGMAS standard deviations, and LEAST_CUT at least; clips() gives
one row for each shot with its times.

write_avi() is the lossless store of the query: each payload byte is the DC term of one 8x8 block. The quantiser of
the DC term is 8, so that a block decodes to the byte's value in all 64 samples, in any JPEG decoder; 8-bit samples
at scale 8 are the payload. The Huffman table gives a difference of category s a code of 9 - s bits and the block
end one bit, so that every block has 10 bits and whole frames are packed as arrays. The query decodes the stored
frames like any others.

Rows are independent; a piece of an Arrow batch (PIECE_BYTES of text, or one text) is in memory with its media, and
GROUP frames with the tables of their bit places. Nothing is shuffled or collected.

Defined cases: null media has null clips, null text an all-zero payload; a text of any length is stored whole, in
memory in proportion to it; a broken file gives an error text, not an exception; an index entry that points outside
the file is skipped; frames of equal difference to the limit aren't cut (ties belong to the shot before); repeated rows
are treated each for themselves; an empty table gives no rows; columns that are not named in the arguments are ignored,
whatever their names; a name in keep that the result has already is refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import clash, map_texts, prepare, read

FPS = 25
#: Blocks in a row and rows in a frame of the lossless store.
ACROSS, DOWN = 32, 32
UNIT = 64
BINS = 16
WINDOW = 8
SIGMAS = 3.0
LEAST_CUT = 0.25
CHUNK = struct.Struct("<4sI")
#: Frames that are read side by side.
GROUP = 256
RESTART = re.compile(rb"\xff[\xd0-\xd7]")

# The zigzag order of ITU T.81 as row-major positions, from its rule.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


# The lossless store


def _codes() -> np.ndarray:
    """difference + 255 -> 10 bits: a code of 9 - s bits, s bits of the value, the block end."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1  # 8 - s ones and a zero
        out[d + 255] = (prefix << s | (d if d >= 0 else d + (1 << s) - 1)) << 1
    return out


CODES = _codes()
DC_LENGTHS = bytes([1] * 9 + [0] * 7)
DC_SYMBOLS = bytes(range(8, -1, -1))
AC_LENGTHS = bytes([1] + [0] * 15)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head(across: int, down: int) -> bytes:
    tables = _segment(0xDB, b"\0" + bytes([8] + [1] * 63)) + _segment(0xC4, b"\x00" + DC_LENGTHS + DC_SYMBOLS + b"\x10" + AC_LENGTHS + b"\0")
    return b"\xff\xd8" + tables + _segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + b"\x01\x11\x00") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def pack(values: np.ndarray) -> np.ndarray:
    """10-bit values, four at a time, to bytes."""
    v = values.reshape(-1, 4)
    out = np.empty((len(v), 5), np.uint8)
    out[:, 0] = v[:, 0] >> 2
    out[:, 1] = (v[:, 0] & 3) << 6 | v[:, 1] >> 4
    out[:, 2] = (v[:, 1] & 15) << 4 | v[:, 2] >> 6
    out[:, 3] = (v[:, 2] & 63) << 2 | v[:, 3] >> 8
    out[:, 4] = v[:, 3] & 255
    return out.reshape(-1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return CHUNK.pack(name, len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """payload (a positive multiple of 64 bytes) as a motion-JPEG AVI; its length is kept as a comment."""
    rows = len(payload) // ACROSS
    down = min(DOWN, rows)
    frames = -(-rows // down)
    x = np.zeros(frames * down * ACROSS, np.int16)
    x[: len(payload)] = np.frombuffer(payload, np.uint8)
    x = x.reshape(frames, -1) - np.int16(128)
    d = np.diff(x, axis=1, prepend=np.int16(0))
    data = pack(CODES[d.reshape(-1) + 255]).reshape(frames, -1)
    head = frame_head(ACROSS, down)
    width, height = 8 * ACROSS, 8 * down
    movi, index, at = [b"movi"], [], 4
    for f in data:
        jpeg = head + f.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"
        index.append(struct.pack("<4sIII", b"00dc", 16, at, len(jpeg)))
        movi.append(_chunk(b"00dc", jpeg))
        at += len(movi[-1])
    largest = max(map(len, movi))
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


# RIFF


class Avi:
    """frames: (offset, length) of each video chunk, in order; seconds: of one frame; comment: ICMT."""

    def __init__(self, data: bytes):
        if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.data, self.seconds, self.comment = data, 1 / FPS, b""
        self.width = self.height = 0
        movi = index = None
        for name, at, n in self._walk(12, len(data)):
            if name == b"LIST" and data[at : at + 4] == b"movi":
                movi = (at, n)
            elif name == b"LIST":
                for inner, a, m in self._walk(at + 4, at + n):
                    if inner == b"avih":
                        if micro := struct.unpack_from("<I", data, a)[0]:
                            self.seconds = micro / 1e6
                        self.width, self.height = struct.unpack_from("<II", data, a + 32)
                    elif inner == b"ICMT":
                        self.comment = data[a : a + m]
            elif name == b"idx1":
                index = (at, n)
        if movi is None:
            raise ValueError("no movi list")
        self.frames = self._indexed(movi, index) if index else []
        if not self.frames:
            self.frames = [(a, m) for name, a, m in self._walk(movi[0] + 4, movi[0] + movi[1]) if name[2:] in (b"dc", b"db")]

    def _walk(self, at: int, end: int):
        end = min(end, len(self.data))
        while at + 8 <= end:
            name, n = CHUNK.unpack_from(self.data, at)
            yield name, at + 8, min(n, end - at - 8)
            at += 8 + n + (n & 1)

    def _indexed(self, movi: tuple[int, int], index: tuple[int, int]) -> list[tuple[int, int]]:
        """Offsets count from movi or, in some files, from the start of the file."""
        entries = [struct.unpack_from("<4sIII", self.data, index[0] + 16 * i) for i in range(index[1] // 16)]
        entries = [(e[2], e[3]) for e in entries if e[0][2:] in (b"dc", b"db")]
        if not entries:
            return []
        base = movi[0] if self.data[movi[0] + entries[0][0] :][:4][2:] in (b"dc", b"db") else 0
        return [(base + o + 8, n) for o, n in entries if base + o + 8 + n <= len(self.data)]


# JPEG


def huffman(lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By 16 bits ahead, the bits of the code (0 where none fits) and the symbol."""
    sizes, values = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    code = k = 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            first = code << (16 - n)
            sizes[first : first + (1 << (16 - n))] = n
            values[first : first + (1 << (16 - n))] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return sizes, values


class Frame:
    """The parsed segments of a baseline JPEG."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.restart, self.parts, self.start = 0, [], 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while not self.start:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("JPEG ends before its scan")
            marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide, key = body[0] >> 4, body[0] & 15
                    self.quant[key] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n_symbols = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n_symbols])
                    body = body[17 + n_symbols :]
            elif marker == 0xC0 or marker == 0xC1:
                if body[0] != 8:
                    raise ValueError("only 8-bit JPEG")
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(body[5])]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only baseline JPEG")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                which = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                for p in self.parts:
                    p[4], p[5] = which[p[0]] >> 4, 0x10 | which[p[0]] & 15
                self.start = at
        if not self.parts:
            raise ValueError("JPEG without a frame header")
        end = data.rfind(b"\xff\xd9")
        self.coded = data[self.start : end if end > 0 else len(data)]

    def alone(self) -> tuple | None:
        """The tables of a scan of one component without restarts: what flat() needs to be equal."""
        if len(self.parts) != 1 or self.restart:
            return None
        return self.tables.get(self.parts[0][4]), self.tables.get(self.parts[0][5])

    def coefficients(self) -> list[np.ndarray]:
        """Of each component: blocks down, blocks across, 64 quantised terms in zigzag order."""
        hmax, vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            hmax = vmax = self.parts[0][1] = self.parts[0][2] = 1
        mx, my = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
        planes = [np.zeros((my * p[2], mx * p[1], 64), np.int32) for p in self.parts]
        tables = {k: tuple(x.tolist() for x in huffman(*v)) for k, v in self.tables.items()}
        mcu, per = 0, self.restart or mx * my
        for run in RESTART.split(self.coded):
            data = run.replace(b"\xff\0", b"\xff")
            end, pos, last = 8 * len(data), 0, [0] * len(self.parts)
            data += b"\xff" * 8
            for mcu in range(mcu, min(mcu + per, mx * my)):
                y, x = divmod(mcu, mx)
                for k, p in enumerate(self.parts):
                    dc, ac = tables[p[4]], tables[p[5]]
                    for v in range(p[2]):
                        for h in range(p[1]):
                            block = planes[k][y * p[2] + v, x * p[1] + h]
                            i = 0
                            while i < 64:
                                at = pos >> 3
                                ahead = int.from_bytes(data[at : at + 5], "big") << (pos & 7)  # 32 bits are whole
                                sizes, symbols = ac if i else dc
                                size, symbol = sizes[ahead >> 24 & 0xFFFF], symbols[ahead >> 24 & 0xFFFF]
                                if not size or pos > end:
                                    raise ValueError("broken JPEG data")
                                pos += size
                                if i and symbol == 0:
                                    break
                                if i and symbol == 0xF0:
                                    i += 16
                                    continue
                                i += symbol >> 4 if i else 0
                                s = symbol & 15
                                value = ahead >> (40 - size - s) & ((1 << s) - 1)
                                pos += s
                                if s and value < 1 << (s - 1):
                                    value -= (1 << s) - 1
                                if i == 0:
                                    value = last[k] = last[k] + value
                                if i > 63:
                                    raise ValueError("broken JPEG block")
                                block[i] = value
                                i += 1
            mcu += 1
        return planes


def block_lengths(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> np.ndarray | None:
    """By 16 bits ahead, the bits of a block with a DC term only (0: not such a block); None if 16 can't always tell."""
    (dc_sizes, dc_symbols), (ac_sizes, ac_symbols) = huffman(*dc), huffman(*ac)
    step = np.where((dc_sizes > 0) & (dc_symbols < 12), dc_sizes + dc_symbols, 0).astype(np.int64)
    rest = np.arange(65536) << step & 0xFFFF
    whole = (ac_symbols[rest] == 0) & (ac_sizes[rest] > 0) & (step > 0)
    if (step > 15).any() or (whole & (step + ac_sizes[rest] > 16)).any():
        return None
    return np.where(whole, step + ac_sizes[rest], 0).astype(np.uint8)


def flat(frames: list[Frame]) -> list[np.ndarray | None]:
    """The quantised DC terms of frames with the same alone(), in scan order; None for a frame with any other term, or
    with broken data."""
    tables = frames[0].alone()
    lengths = block_lengths(*tables)
    if lengths is None:
        return [None] * len(frames)
    coded = [f.coded.replace(b"\xff\0", b"\xff") for f in frames]
    blocks = [-(-f.height // 8) * -(-f.width // 8) for f in frames]
    most = max(blocks)
    raw = np.frombuffer(b"".join([*(x + b"\xff\xff" for x in coded), b"\xff" * (2 * most + 8)]), np.uint8).astype(np.int64)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    here = np.empty((len(three), 8), np.uint8)  # the length of a block at every bit place
    for i in range(8):
        here[:, i] = lengths[three >> (8 - i) & 0xFFFF]
    here = here.reshape(-1)
    at = np.empty((most + 1, len(frames)), np.int64)
    at[0] = np.cumsum([0, *(8 * (len(x) + 2) for x in coded[:-1])])
    for j in range(most):
        np.add(at[j], here[at[j]], out=at[j + 1])  # at anything else than such a block it stands still
    bits = lambda p: three[p >> 3] >> (8 - (p & 7)) & 0xFFFF
    sizes, symbols = huffman(*tables[0])
    code = bits(at[:-1])
    size = symbols[code].astype(np.int64)
    value = bits(at[:-1] + sizes[code]) >> (16 - size)
    terms = np.cumsum(np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value), axis=0)
    good = [at[n, i] > at[n - 1, i] and at[n, i] <= at[0, i] + 8 * len(x) for i, (n, x) in enumerate(zip(blocks, coded))]
    return [terms[:n, i] if ok else None for i, (n, ok) in enumerate(zip(blocks, good))]


def decode_all(datas: list[bytes], scale: int = 1) -> list[np.ndarray]:
    """The luma planes of baseline JPEGs as 8-bit samples; scale 8: an eighth of the size, from the DC terms."""
    frames = [Frame(x) for x in datas]
    terms: list[np.ndarray | None] = [None] * len(frames)
    alike: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        if scale == 8 and (key := f.alone()) and None not in key:
            alike.setdefault(key, []).append(i)
    for group in alike.values():
        for a in range(0, len(group), GROUP):
            own = group[a : a + GROUP]
            for i, x in zip(own, flat([frames[i] for i in own])):
                terms[i] = x
    return [_plane(f, scale, x) for f, x in zip(frames, terms)]


def decode(data: bytes, scale: int = 1) -> np.ndarray:
    return decode_all([data], scale)[0]


def _plane(f: Frame, scale: int, terms: np.ndarray | None) -> np.ndarray:
    q = f.quant[f.parts[0][3]]
    if terms is None:
        planes = f.coefficients()[0]
        down, across = planes.shape[:2]
        terms = planes[:, :, 0]
    if scale == 8:
        out = np.rint(terms.reshape(-(-f.height // 8) if len(f.parts) == 1 else down, -1) * (q[0] / 8)) + 128
        return np.clip(out[: -(-f.height // 8), : -(-f.width // 8)], 0, 255).astype(np.uint8)
    terms = np.zeros((down, across, 64))
    terms[:, :, ZIGZAG] = planes * q
    out = DCT.T @ terms.reshape(down, across, 8, 8) @ DCT
    out = np.rint(out.transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)) + 128
    return np.clip(out[: f.height, : f.width], 0, 255).astype(np.uint8)


def histograms(frames: np.ndarray) -> np.ndarray:
    """Of each frame, the shares of BINS equal ranges of luma."""
    n = len(frames)
    flat = frames.reshape(n, -1)
    shift = 8 - BINS.bit_length() + 1
    keys = (flat >> shift).astype(np.int64) + BINS * np.arange(n)[:, None]
    return np.bincount(keys.reshape(-1), minlength=BINS * n).reshape(n, BINS) / flat.shape[1]


def shots(hist: np.ndarray) -> list[int]:
    """First frames of the shots."""
    if not len(hist):
        return []
    diff = (np.abs(np.diff(hist, axis=0)).sum(1) / 2).tolist()
    first, past = [0], deque(maxlen=WINDOW)
    for i, d in enumerate(diff, 1):
        mean = sum(past) / len(past) if past else 0.0
        spread = (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5 if past else 0.0
        if d > max(LEAST_CUT, mean + SIGMAS * spread):
            first.append(i)
            past.clear()
        else:
            past.append(d)
    return first


def frames_of(avis: list[Avi], scale: int = 8) -> list[np.ndarray]:
    """The frames of each file, decoded together."""
    got = decode_all([a.data[at : at + n] for a in avis for at, n in a.frames], scale)
    out, first = [], 0
    for a in avis:
        own = got[first : first + len(a.frames)]
        first += len(a.frames)
        if len({g.shape for g in own}) > 1:
            raise ValueError("frames differ in size")
        out.append(np.stack(own) if own else np.zeros((0, 0, 0), np.uint8))
    return out


def clip_rows(media: bytes) -> list[dict]:
    """One entry for each shot: clip, first_frame, frames, start_s, end_s, mean_luma."""
    avi = Avi(media)
    x = frames_of([avi])[0]
    first = shots(histograms(x))
    return [
        {"clip": i, "first_frame": a, "frames": b - a, "start_s": a * avi.seconds, "end_s": b * avi.seconds, "mean_luma": float(x[a:b].mean())}
        for i, (a, b) in enumerate(zip(first, [*first[1:], len(x)]))
    ]


def clips(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """keep and the columns of clip_rows() for every shot of every AVI in media_col (binary); error for broken files."""
    import pandas as pd

    prepare(df.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = ["clip", "first_frame", "frames", "start_s", "end_s", "mean_luma"]
    clash(keep, [*cols, "error"])
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "clip int, first_frame int, frames int, start_s double, end_s double, mean_luma double, error string"])

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                if row[-1] is None:
                    continue
                try:
                    rows += [[*row[:-1], *(r[c] for c in cols), None] for r in clip_rows(bytes(row[-1]))]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append([*row[:-1], None, None, None, None, None, None, f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=[*keep, *cols, "error"])

    return df.select(*keep, media_col).mapInPandas(run, ddl)


DIGEST = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def digests(texts: list[str | None]) -> list[tuple]:
    """The stores of texts, read back: the DIGEST of each."""
    raws = [(t or "").encode() for t in texts]
    medias = [write_avi(raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)) for raw in raws]
    avis = [Avi(m) for m in medias]
    out = []
    for raw, media, avi, x in zip(raws, medias, avis, frames_of(avis)):
        payload = x.tobytes()[: int(avi.comment.partition(b"=")[2])]
        hist = histograms(x)
        first = shots(hist)
        times = ",".join(f"{a * avi.seconds:.2f}" for a in first)
        feature = f"frames={len(x)};size={avi.width}x{avi.height};shots={len(first)};starts={times};luma={x.mean():.4f};peak={int(hist.sum(0).argmax())}"
        out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    return out


def store(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and the DIGEST of every row's text, stored as AVI motion-JPEG and read back."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(docs, keep, schema, lambda texts: dict(zip(DIGEST, map(list, zip(*digests(texts))))), text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every text stored as AVI motion-JPEG, read back and described."""
    return store(read(spark, sf_dir, "documents"), ["doc_id"])
