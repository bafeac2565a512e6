"""AVI motion-JPEG: lossless storage of bytes in intra frames, reading by the RIFF index, shots as timed clips.

A frame is a baseline grey JPEG. Its 64 quantised coefficients per block are the format's unit: a byte v is the
coefficient of size category 8 whose eight magnitude bits are v, so every coefficient takes one code bit and those
eight bits. Each block is a restart interval, which resets the DC prediction and bounds damage to one block. The last
frame is filled with zero blocks; the payload's length stands in the INFO list. Pixels come from the inverse DCT; a
shot starts where the histogram difference to the frame before exceeds the recent mean by several deviations.

Files of other writers are read too: frames of any baseline coder (jpeg.py), with or without an index. A frame that
cannot be decoded counts as like the one before it; a file without any decodable frame, or that is no AVI, gives one
quarantine row with the reason instead of clips. An empty payload gives an AVI without frames and no clips; null media
give no rows; repeated rows are rows like any other; a column of the name asked for is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .jpeg import DCT, ZIGZAG, luma

BLOCKS = 32  # a full frame's: 64 x 32 pixels
FPS = 25
_CHUNK = 256  # frames coded at once


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    code = bytes([1] + [0] * 15 + [8])  # one code of one bit, for size category 8
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0") + _segment(0xC4, b"\0" + code) + _segment(0xC4, b"\x10" + code) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0")


def _scans(blocks: np.ndarray, per_frame: int) -> list[bytes]:
    """Entropy-coded data of frames of per_frame blocks each, with stuffing and restart markers."""
    bits = np.zeros((len(blocks), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(-1, 64, 8)
    data = np.packbits(bits.reshape(len(blocks), -1), axis=1).ravel()
    stuffed = data == 255
    block = np.arange(len(data)) // 72
    at = np.arange(len(data)) + np.cumsum(stuffed) - stuffed + 2 * block
    ends = at[71::72] + 1 + stuffed[71::72]  # where each block's marker goes
    out = np.zeros(ends[-1] + 2, np.uint8)
    out[at] = data
    out[ends] = 255
    out[ends + 1] = 0xD0 + np.arange(len(blocks)) % per_frame % 8
    frames = np.concatenate([[0], ends[per_frame - 1 :: per_frame] + 2])
    return [out[a : b - 2].tobytes() for a, b in zip(frames[:-1], frames[1:])]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """payload (a multiple of 64 bytes) as an AVI file."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    across = max(1, min(8, len(blocks)))
    down = max(1, -(-min(BLOCKS, len(blocks)) // across))
    per = across * down
    frames = -(-len(blocks) // per)
    head, movi = _head(across * 8, down * 8), []
    for a in range(0, frames, _CHUNK):
        some = blocks[a * per : (a + _CHUNK) * per]
        some = np.concatenate([some, np.zeros((-len(some) % per, 64), np.uint8)])
        movi += [_chunk(b"00dc", head + x + b"\xff\xd9") for x in _scans(some, per)]
    size = max(map(len, movi), default=0)
    sizes = np.array([len(x) for x in movi], np.int64)
    starts = 4 + np.cumsum(sizes) - sizes
    index = b"".join(struct.pack("<4sIII", b"00dc", 0x10, int(at), int.from_bytes(x[4:8], "little")) for at, x in zip(starts, movi))
    avih = struct.pack("<14I", 10**6 // FPS, size * FPS, 0, 0x10, frames, 0, 1, size, across * 8, down * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, size, 10000, 0, 0, 0, across * 8, down * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, across * 8, down * 8, 1, 8, b"MJPG", across * down * 64, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", index))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        n = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > end:
            raise ValueError("a RIFF chunk is cut off")
        yield data[at : at + 4], at + 8, n
        at += 8 + n + n % 2


def parse_avi(data: bytes) -> tuple[int | None, float, list[bytes]]:
    """Payload length (None if the file doesn't say), frames a second and the JPEG frames that the index lists."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    length, fps, movis, index = None, float(FPS), [], b""
    for name, at, n in _chunks(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"movi":
            movis.append((at, n))
        elif name == b"idx1":
            index = data[at : at + n // 16 * 16]
        elif name == b"LIST" and kind == b"INFO":
            for sub, to, m in _chunks(data, at + 4, at + n):
                if sub == b"ICMT" and data[to : to + 8] == b"payload=" and data[to + 8 : to + m].rstrip(b"\0").isdigit():
                    length = int(data[to + 8 : to + m].rstrip(b"\0"))
        elif name == b"LIST" and kind == b"hdrl" and n >= 16:
            fps = 1e6 / max(1, struct.unpack_from("<I", data, at + 12)[0])
    if not movis:
        raise ValueError("an AVI file without frames")
    frames = []
    for name, _, at, n in struct.iter_unpack("<4sIII", index):
        if name[2:] == b"dc":
            begin = movis[0][0] + at
            if data[begin : begin + 4] != name:  # some writers count from the file's start
                begin = at
            if data[begin : begin + 4] != name:
                raise ValueError("an index entry without its frame")
            frames.append(data[begin + 8 : begin + 8 + n])
    if not index:
        frames = [data[to : to + m] for at, n in movis for name, to, m in _movi(data, at + 4, at + n) if name[2:] == b"dc"]
    return length, fps, frames


def _movi(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Chunks of a movi list, also those inside rec lists."""
    for name, to, n in _chunks(data, at, end):
        if name == b"LIST":
            yield from _movi(data, to + 4, to + n)
        else:
            yield name, to, n


def _scan_of(frame: bytes) -> tuple[int, int, bytes]:
    """Width, height and entropy-coded data of a frame, whose markers are checked."""
    if frame[:2] != b"\xff\xd8" or frame[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG frame")
    at, width, height = 2, 0, 0
    while at + 4 <= len(frame):
        marker, n = struct.unpack_from(">xBH", frame, at)
        if marker == 0xC0:
            height, width = struct.unpack_from(">HH", frame, at + 5)
        elif marker == 0xC4 and (frame[at + 5 : at + 22] != bytes([1] + [0] * 15 + [8])):
            raise ValueError("a code table of another coder")
        at += 2 + n
        if marker == 0xDA:
            return width, height, frame[at:-2]
    raise ValueError("a JPEG frame without a scan")


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Quantised coefficients as bytes, (frames, blocks, 64). All frames have one size."""
    scans = [_scan_of(x) for x in frames]
    per = scans[0][0] * scans[0][1] // 64 if scans else 0
    out = np.empty((len(frames), per, 64), np.uint8)
    for a in range(0, len(frames), _CHUNK):
        some = scans[a : a + _CHUNK]
        data = np.frombuffer(b"".join(x[2] + b"\xff\xd0" for x in some), np.uint8)
        mark = np.flatnonzero(data[:-1] == 255)
        keep = np.ones(len(data), bool)
        after = data[mark + 1]
        keep[mark[after == 0] + 1] = False
        restart = mark[(after >= 0xD0) & (after <= 0xD7)]
        keep[restart] = keep[restart + 1] = False
        data = data[keep]
        if len(data) != len(some) * per * 72 or len(restart) != len(some) * per:
            raise ValueError("a damaged scan")
        bits = np.unpackbits(data.reshape(-1, 72), axis=1).reshape(-1, 64, 9)
        if bits[:, :, 0].any():
            raise ValueError("an unknown code")
        out[a : a + len(some)] = np.packbits(bits[:, :, 1:].reshape(-1, 512), axis=1).reshape(len(some), per, 64)
    return out


def read_avi(data: bytes) -> tuple[bytes, float, np.ndarray]:
    """Payload, frames a second and coefficients."""
    length, fps, frames = parse_avi(data)
    units = decode_frames(frames)
    return units.tobytes()[:length], fps, units


def histograms(units: np.ndarray, bins: int = 16) -> np.ndarray:
    """Shares of luminance bins of each frame, from the pixels."""
    out = np.zeros((len(units), bins))
    for a in range(0, len(units), _CHUNK):
        some = units[a : a + _CHUNK]
        coefficient = np.empty((some.shape[0] * some.shape[1], 64), np.float32)
        signed = some.reshape(-1, 64).astype(np.float32)
        signed[signed < 128] -= 255
        coefficient[:, ZIGZAG] = signed
        half = (coefficient.reshape(-1, 8) @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1)
        pixel = np.clip(half.reshape(-1, 8) @ DCT + 128, 0, 255).reshape(len(some), -1)
        level = (pixel * np.float32(bins / 256)).astype(np.int64) + np.arange(len(some))[:, None] * bins
        out[a : a + len(some)] = np.bincount(level.ravel(), minlength=len(some) * bins).reshape(-1, bins) / pixel.shape[1]
    return out


def shots(histogram: np.ndarray, window: int = 12, factor: float = 2.5, least: float = 0.08) -> list[tuple[int, int]]:
    """First and end frame of each shot. A cut needs a difference over `least` and over the mean plus `factor`
    deviations of the differences in the window before it, which restarts at each cut."""
    if not len(histogram):
        return []
    step = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / 2
    cuts, since = [0], 0
    for k, d in enumerate(step):
        past = step[max(since, k - window) : k]
        if d > least and len(past) >= 2 and d > past.mean() + factor * past.std():
            cuts.append(k + 1)
            since = k + 1
    return list(zip(cuts, [*cuts[1:], len(histogram)]))


def _own(frame: bytes) -> bool:
    """Whether a frame was written here, so that its blocks can be read all at once."""
    at = frame.find(b"\xff\xc0")
    return at > 0 and frame.startswith(_head(*struct.unpack_from(">HH", frame[at : at + 9].ljust(9, b"\0"), 5)[::-1]))


def frame_histograms(frames: list[bytes], bins: int = 16) -> tuple[np.ndarray, int]:
    """Shares of luminance bins of each frame, and how many frames could not be decoded (they repeat their forerunner)."""
    if frames and all(map(_own, frames)) and len({_scan_of(x)[:2] for x in frames}) == 1:
        try:
            return histograms(decode_frames(frames), bins), 0
        except ValueError:
            pass  # a damaged frame: one by one below
    out: list[np.ndarray | None] = []
    for frame in frames:
        try:
            level = (luma(frame) * np.float32(bins / 256)).astype(np.int64).ravel()
            out.append(np.bincount(level, minlength=bins) / len(level))
        except ValueError as e:
            why = e
            out.append(None)
    good = [x for x in out if x is not None]
    if frames and not good:
        raise ValueError(f"no frame can be decoded: {why}")
    last, bad = good[0] if good else None, len(out) - len(good)
    for k, x in enumerate(out):
        last = out[k] = last if x is None else x
    return np.array(out).reshape(-1, bins), bad


def clips(data: bytes) -> list[dict]:
    """Timed clips of an AVI file."""
    _, fps, frames = parse_avi(data)
    return _clips(frame_histograms(frames)[0], fps)


def _clips(histogram: np.ndarray, fps: float) -> list[dict]:
    return [{"clip": k, "first_frame": a, "frames": b - a, "start_s": a / fps, "end_s": b / fps} for k, (a, b) in enumerate(shots(histogram))]


_CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def clip_rows(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row per clip of every AVI in df (null media: no rows); a file that cannot be read has one row with an error."""
    kind = dict(df.dtypes)[id_col]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found += [{"id": i, **c, "error": None} for c in clips(m)] if m is not None else []
                except (ValueError, struct.error) as e:
                    found.append({"id": i, "error": str(e)})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("id", b.column(0).type), *((f.name, f.type) for f in _CLIP), ("error", pa.string())]))

    return df.select(id_col, media_col).mapInArrow(rows, f"id {kind}, clip int, first_frame long, frames long, start_s double, end_s double, error string").withColumnRenamed("id", id_col)


def avi_column(df: DataFrame, payload_col: str, media_col: str = "media") -> DataFrame:
    """df with the AVI of a binary payload column (null: empty), padded by zero bytes to a positive multiple of 64."""
    encode = F.udf(lambda x: write_avi(padded(bytes(x or b""))), "binary", useArrow=True)
    return df.withColumn(media_col, encode(payload_col))


def padded(raw: bytes) -> bytes:
    return raw + bytes(64 - len(raw) if len(raw) < 64 else -len(raw) % 64)


def _digest(raw: bytes) -> tuple:
    media = write_avi(padded(raw))
    payload, fps, units = read_avi(media)
    histogram = histograms(units)
    found = _clips(histogram, fps)
    named = ",".join(f"{c['start_s']:g}-{c['end_s']:g}" for c in found)
    mean = ",".join(f"{x:.4f}" for x in histogram.mean(axis=0))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(units)};shots={named};luma={mean}", len(found), found


def op9_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text through write_avi and read_avi, with its timed clips. Null texts count as empty; equal texts give
    equal values; an empty table gives no rows."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips", "clips")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(_CLIP))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                made = list(zip(*(_digest(bytes(x.as_buffer() or b"") if x.is_valid else b"") for x in part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(made, types))], names=["doc_id", *names])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips int, clips array<struct<clip: int, first_frame: long, frames: long, start_s: double, end_s: double>>")
