"""Media columns: AVI files of Motion-JPEG frames, written, parsed, decoded and cut into shots.

A payload of bytes is stored without loss in the unit of the format, the
quantised coefficient: byte b is the coefficient of magnitude category 8 whose
extra bits are b (-255..-128 for 0..127, 128..255 for 128..255).  The tables
give category 8 the one-bit code 0, so that a block of 64 coefficients has 576
bits; with a restart after each block the difference that codes the first
coefficient is the coefficient itself.  Frames are intra frames throughout.

Frames of any file are decoded to pixels: baseline frames with their own
quantisation and Huffman tables, of one or more components, with or without
restarts (progressive ones, and ones that leave their tables out, are refused).
Shots are cut where the histograms of the pixels' brightness differ more than
around them.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessella.llm.words import blocks, given, returned, tune

WIDTH, HEIGHT, FPS = 64, 32, 25
BLOCK = 64
CHUNK_FRAMES = 256
FRAME_BLOCKS = WIDTH * HEIGHT // BLOCK

DIGEST = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame:int,n_frames:int,start_s:double,end_s:double>>"
CLIPS = "doc_id string, clip int, first_frame int, n_frames int, start_s double, end_s double"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    """All that stands before a frame's coded blocks; one symbol per table: category 8, after a run of no zeros."""
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + b"\x01" + b"\x00" * 15 + b"\x08"),
            _segment(0xC4, b"\x10" + b"\x01" + b"\x00" * 15 + b"\x08"),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        )
    )


HEAD = _frame_head(WIDTH, HEIGHT)


def encode_frames(payload: bytes) -> list[bytes]:
    """Frames that hold ``payload``, whose length is a multiple of 64; the last frame is filled up with blocks of zeros."""
    n = len(payload) // BLOCK
    frames = max(1, -(-n // FRAME_BLOCKS))
    units = np.zeros((frames * FRAME_BLOCKS, BLOCK), np.uint8)
    units[:n] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    bits = np.zeros((len(units), BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(units, axis=1).reshape(len(units), BLOCK, 8)
    coded = np.empty((len(units), 74), np.uint8)
    coded[:, :72] = np.packbits(bits.reshape(len(units), -1), axis=1)
    coded[:, 72], coded[:, 73] = 0xFF, 0xD0 + np.arange(len(units)) % FRAME_BLOCKS % 8
    times = np.ones(coded.shape, np.int8)
    times[:, :72] += coded[:, :72] == 0xFF  # a 0xFF within the data is followed by 0x00
    times[FRAME_BLOCKS - 1 :: FRAME_BLOCKS, 72:] = 0  # no restart after a frame's last block
    times = times.ravel()
    out = np.repeat(coded.ravel(), times)
    out[np.cumsum(times)[times == 2] - 1] = 0
    ends = np.cumsum(times.reshape(frames, -1).sum(axis=1, dtype=np.int64))
    data = out.tobytes()
    return [HEAD + data[a:b] + b"\xff\xd9" for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file with one video stream and its index; the payload's length stands in the stream's ``strd`` chunk."""
    frames = encode_frames(payload)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, -1, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        movi.append(chunk)
        at += len(chunk)
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    if len(body) >= 1 << 32:
        raise ValueError("a RIFF file holds less than 4 GiB")
    return _chunk(b"RIFF", body)


@dataclass
class Avi:
    width: int
    height: int
    fps: float
    payload_bytes: int | None
    frames: list[bytes]


def read_avi(media: bytes) -> Avi:
    """Parses the RIFF tree and takes the video frames by the index, or in the order of the movie list where there is none.

    Places in the index count from the movie list or from the file's start.
    payload_bytes is None in files that do not say it.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if at + 8 + size > end:
                raise ValueError("a chunk is cut short")
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                found[kind] = (at + 8, size)
                if kind != b"movi":
                    walk(at + 12, at + 8 + size)
            else:
                found[name] = (at + 8, size)
            at += 8 + size + size % 2

    walk(12, 8 + struct.unpack_from("<I", media, 4)[0])
    head = struct.unpack_from("<14I", media, found[b"avih"][0])
    strh = struct.unpack_from("<IHHIIIIIIiI4H", media, found[b"strh"][0] + 8)
    length = struct.unpack_from("<Q", media, found[b"strd"][0])[0] if found.get(b"strd", (0, 0))[1] == 8 else None
    base, listed = found[b"movi"]
    frames = []
    if b"idx1" in found:
        at, size = found[b"idx1"]
        for name, _, offset, n in struct.iter_unpack("<4sIII", media[at : at + size - size % 16]):
            if name[2:] not in (b"dc", b"db"):
                continue
            start = base + offset if media[base + offset : base + offset + 4] == name else offset
            if media[start : start + 4] != name:
                raise ValueError("the index points to no chunk")
            frames.append(media[start + 8 : start + 8 + n])
    else:
        at = base + 4
        while at + 8 <= base + listed:
            name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":  # a list of records: go into it
                at += 12
                continue
            if name[2:] in (b"dc", b"db"):
                frames.append(media[at + 8 : at + 8 + n])
            at += 8 + n + n % 2
    return Avi(head[8], head[9], strh[5] / max(1, strh[4]), length, frames)


def scan_data(frame: bytes) -> bytes:
    """The coded blocks of a frame that :func:`encode_frames` made."""
    if not frame.startswith(HEAD) or frame[-2:] != b"\xff\xd9":
        raise ValueError("not a frame that holds a payload")
    return frame[len(HEAD) : -2]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The stored units of all frames, a row for each frame: the inverse of :func:`encode_frames`."""
    data = np.frombuffer(b"".join(map(scan_data, frames)), np.uint8)
    mark = data[:-1] == 0xFF
    keep = np.ones(len(data), bool)
    keep[1:] &= ~(mark & (data[1:] == 0))
    restart = np.flatnonzero(mark & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
    keep[restart] = keep[restart + 1] = False
    coded = data[keep]
    if len(coded) % (72 * FRAME_BLOCKS):
        raise ValueError("a frame is cut short")
    bits = np.unpackbits(coded.reshape(-1, 72), axis=1).reshape(-1, BLOCK, 9)
    if bits[:, :, 0].any():
        raise ValueError("a code that the table lacks")
    return np.packbits(bits[:, :, 1:].reshape(len(bits), -1), axis=1).reshape(-1, FRAME_BLOCKS * BLOCK)


def _zigzag() -> np.ndarray:
    """For each coefficient in the order of the file its place in the block, row by row: diagonals, up and down in turn."""
    places = [(i, j) for i in range(8) for j in range(8)]
    order = sorted(places, key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * i + j for i, j in order])


ZIGZAG = _zigzag()
_COSINE = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for u in range(8)] for x in range(8)])
#: Coefficients in the file's order to the 64 samples of a block.
INVERSE = np.ascontiguousarray(np.einsum("yv,xu->yxvu", _COSINE, _COSINE).reshape(64, 64)[:, ZIGZAG].T.astype(np.float32))


def samples_of(coefficients: np.ndarray, quantisers: np.ndarray) -> np.ndarray:
    """Blocks of coefficients, in the file's order, as blocks of 64 samples: scaled, transformed, raised by 128 and cut to a byte."""
    values = (coefficients.astype(np.float32) * quantisers.astype(np.float32)) @ INVERSE
    return np.clip(np.rint(values + 128), 0, 255).astype(np.uint8)


def _codes(body: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a Huffman table: codes of a length follow each other."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            out[length, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@dataclass
class _Bits:
    """The bits of one stretch between restarts; beyond its end there are ones."""

    data: bytes
    at: int = 0

    def take(self, n: int) -> int:
        out = 0
        for k in range(self.at, self.at + n):
            out = out << 1 | (self.data[k >> 3] >> (7 - (k & 7)) & 1 if k >> 3 < len(self.data) else 1)
        self.at += n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a code that the table lacks")

    def signed(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _stretches(coded: bytes) -> list[bytes]:
    """The coded data between restarts, without the zeros that follow a 0xFF of the data."""
    out, cur, at = [], bytearray(), 0
    while at < len(coded):
        if coded[at] != 0xFF:
            cur.append(coded[at])
            at += 1
            continue
        mark = coded[at + 1] if at + 1 < len(coded) else 0xD9
        if mark == 0:
            cur.append(0xFF)
        elif 0xD0 <= mark <= 0xD7:
            out.append(bytes(cur))
            cur = bytearray()
        elif mark != 0xFF:
            break
        at += 1 if mark == 0xFF else 2
    return [*out, bytes(cur)]


def decode_frame(frame: bytes) -> np.ndarray:
    """The brightness (first component) of a baseline JPEG frame as rows of pixels."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant, codes, every, size, parts = {}, {}, 0, (0, 0), []
    at = 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind, n = struct.unpack_from(">xBH", frame, at)
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                many = sum(body[1:17])
                codes[body[0]] = _codes(body[1 : 17 + many])
                body = body[17 + many :]
        elif kind in (0xC0, 0xC1):
            bits, height, width, many = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples of other than 8 bits")
            size = (height, width)
            parts = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(many)]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("not a baseline frame")
        elif kind == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            tables = {body[1 + 2 * c]: body[2 + 2 * c] for c in range(body[0])}
            break
    if not parts or not all(c in tables and q in quant and tables[c] >> 4 in codes and 0x10 | tables[c] & 15 in codes for c, _, _, q in parts):
        raise ValueError("a component or a table is missing")
    height, width = size
    one = len(parts) == 1  # then a unit is one block, whatever its sampling
    most_h, most_v = (1, 1) if one else (max(p[1] for p in parts), max(p[2] for p in parts))
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    h0, v0 = (1, 1) if one else parts[0][1:3]
    kept = np.zeros((down * v0, across * h0, 64), np.int32)
    stretches = iter(_stretches(frame[at:]))
    bits, last = _Bits(next(stretches)), dict.fromkeys(tables, 0)
    for unit in range(across * down):
        if every and unit and unit % every == 0:
            bits, last = _Bits(next(stretches, b"")), dict.fromkeys(tables, 0)
        for c, (name, h, v, _) in enumerate(parts):
            dc, ac = codes[tables[name] >> 4], codes[0x10 | tables[name] & 15]
            for block in range(1 if one else h * v):
                values = np.zeros(64, np.int32)
                last[name] += bits.signed(bits.symbol(dc))
                values[0], k = last[name], 1
                while k < 64:
                    run, length = divmod(bits.symbol(ac), 16)
                    if not length and run < 15:
                        break
                    k += run
                    if k > 63:
                        raise ValueError("a run beyond the block")
                    values[k] = bits.signed(length)
                    k += 1
                if c == 0:
                    kept[unit // across * v0 + block // h0, unit % across * h0 + block % h0] = values
    pixels = samples_of(kept.reshape(-1, 64), quant[parts[0][3]]).reshape(down * v0, across * h0, 8, 8)
    whole = pixels.transpose(0, 2, 1, 3).reshape(down * v0 * 8, across * h0 * 8)
    return whole[: -(-height * v0 // most_v), : -(-width * h0 // most_h)]


def pixels_of(units: np.ndarray) -> np.ndarray:
    """The pixels of frames that hold a payload, from their stored units; a row for each frame, block by block."""
    v = units.reshape(-1, BLOCK).astype(np.int16)
    return samples_of(np.where(v < 128, v - 255, v), np.ones(BLOCK)).reshape(len(units), -1)


def histograms(samples: np.ndarray) -> np.ndarray:
    """For each row the parts of its samples on 64 levels."""
    n = len(samples)
    level = (samples >> 2).astype(np.int64) + 64 * np.arange(n)[:, None]
    return np.bincount(level.ravel(), minlength=64 * n).reshape(n, 64) / max(1, samples.shape[1])


def frame_histograms(frames: list[bytes], units: np.ndarray | None = None) -> np.ndarray:
    """Brightness histograms of all frames, some frames decoded at a time."""
    out = [np.zeros((0, 64))]
    for a in range(0, len(frames), CHUNK_FRAMES):
        if units is not None:
            out.append(histograms(pixels_of(units[a : a + CHUNK_FRAMES])))
        elif all(f.startswith(HEAD) for f in frames[a : a + CHUNK_FRAMES]):
            out.append(histograms(pixels_of(decode_frames(frames[a : a + CHUNK_FRAMES]))))
        else:
            out += [histograms(decode_frame(f).reshape(1, -1)) for f in frames[a : a + CHUNK_FRAMES]]
    return np.concatenate(out)


def shots(hist: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.08) -> list[int]:
    """First frames of the shots, from the frames' histograms.

    A cut lies where the difference of two neighbouring frames' histograms
    (half the sum of absolute differences, 0 to 1) exceeds the mean by
    ``factor`` standard deviations of the ``window`` differences before and
    after it, and ``least``.
    """
    if len(hist) < 2:
        return [0]
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    sums, squares = np.cumsum(np.r_[0, diff]), np.cumsum(np.r_[0, diff**2])
    at = np.arange(len(diff))
    lo, hi = np.maximum(0, at - window), np.minimum(len(diff), at + window + 1)
    others = np.maximum(1, hi - lo - 1)
    mean = (sums[hi] - sums[lo] - diff) / others
    spread = np.sqrt(np.maximum(0, (squares[hi] - squares[lo] - diff**2) / others - mean**2))
    return [0, *(np.flatnonzero(diff > np.maximum(least, mean + factor * spread)) + 1).tolist()]


def clip_rows(begin: list[int], frames: int, fps: float) -> list[dict]:
    return [{"first_frame": a, "n_frames": b - a, "start_s": a / fps, "end_s": b / fps} for a, b in zip(begin, [*begin[1:], frames], strict=True)]


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's length as UTF-8, and these bytes filled up with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\x00" * (-len(raw) % BLOCK or BLOCK * (not raw))


def _each(docs: DataFrame, row, schema: str) -> DataFrame:
    tune(docs.sparkSession)
    names = [x.split()[0] for x in schema.partition(" array<")[0].split(",")]

    def run(batches):
        for block in blocks(batches):
            out = [x for doc_id, text in zip(block["doc_id"], block["text"], strict=True) for x in row(doc_id, text)]
            yield pd.DataFrame(out, columns=names)

    return returned(given(docs, "text").mapInPandas(run, schema))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as an AVI file.  A null text counts as empty (64 zero bytes); null ids stay null; repeated rows give repeated files; other columns are ignored; an empty table gives an empty table."""
    return _each(docs, lambda doc_id, text: [(doc_id, (p := payload(text))[0], write_avi(p[1]))], "doc_id string, n_bytes long, media binary")


def clips(stored: DataFrame) -> DataFrame:
    """doc_id, media (an AVI file of baseline Motion-JPEG) -> one row per shot: frames and times in seconds.

    A null file, or one without frames, has no clips; a file that is no such
    AVI is an error.  Null ids stay null; repeated rows give repeated clips;
    other columns are ignored; an empty table gives an empty table.
    """
    tune(stored.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, data in zip(batch["doc_id"], batch["media"], strict=True):
                if data is None:
                    continue
                avi = read_avi(data)
                if avi.frames:
                    found = clip_rows(shots(frame_histograms(avi.frames)), len(avi.frames), avi.fps)
                    out += [(doc_id, k, *c.values()) for k, c in enumerate(found)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CLIPS.split(",")])

    return returned(given(stored, "media").mapInPandas(run, CLIPS))


def digest(docs: DataFrame) -> DataFrame:
    """What the stored form of each text gives when it is read back; see DIGEST.

    feature: numbers of frames and shots, a checksum of the first frames of
    all shots, and the mean unit; clips: all shots with their times.  Null
    texts count as empty, null ids stay null; equal texts give equal values;
    repeated rows give repeated rows; other columns are ignored; an empty
    table gives an empty table.
    """

    def row(doc_id, text):
        n, body = payload(text)
        stored = write_avi(body)
        avi = read_avi(stored)
        units = decode_frames(avi.frames)
        back = units.tobytes()[: avi.payload_bytes]
        cuts = shots(frame_histograms(avi.frames, units))
        feature = f"frames={len(avi.frames)};shots={len(cuts)};cuts={zlib.crc32(np.array(cuts, '<u4').tobytes()):08x};mean={np.frombuffer(back, np.uint8).mean():.4f}"
        found = clip_rows(cuts, len(avi.frames), avi.fps)
        return [(doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, found)]

    return _each(docs, row, DIGEST)
