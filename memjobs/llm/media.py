"""Media columns: payloads in AVI motion-JPEG and timed clip rows out of it.

A frame is a baseline grey JPEG whose 8x8 blocks are flat: one payload byte is
the level of one block, carried by the block's DC coefficient at quantiser 8,
which decoders restore without loss.  The Huffman table gives a DC difference
of s bits a prefix of 9-s bits, so each block takes 10 bits (9 and the end of
block) and whole frames encode and decode in a few array operations.  Frames
of other encoders (baseline, grey or colour, any sampling, with or without
restart intervals) are decoded in full, by their Huffman tables and the inverse
cosine transform; their pixels of brightness are the picture.

The reader finds frames through the RIFF index (``idx1``), or by walking the
``movi`` list where there is none.  A shot ends where the histogram difference
of two frames exceeds mean + ``k`` deviations of the last ``memory``
differences of its shot, and an absolute floor.

Defined cases.  Null or empty text: a payload of 64 zero bytes.  Equal texts
give equal files.  ``media_features`` gives nulls for null media and the
feature ``broken`` for files that can't be read; ``clips`` gives no rows for
either.  ``read_frames`` and ``decode_frame`` raise ValueError.  A frame has to
bring its Huffman tables.  Texts go up to 1.5 GB: a binary value of Arrow holds 2 GB.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64  # bytes in a row of blocks
ROWS = 64  # rows of blocks in a frame, at most
FPS = 25
STORE_BYTES = 4 << 20  # text of files that a task writes at once, but for one longer text
# Segment markers of JPEG and the flat-block profile's tables.
SOI, EOI = b"\xff\xd8", b"\xff\xd9"
DC_COUNTS, DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def _profile() -> tuple[np.ndarray, np.ndarray]:
    """The 9 bits of each DC difference (index difference + 255), and back."""
    code = np.zeros(511, np.uint64)
    back = np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (9 - s)) - 2  # lengths 1..9 for s = 8..0
        code[d + 255] = (prefix << s) | (d if d > 0 else d + (1 << s) - 1)
        back[int(code[d + 255])] = d
    return code, back


_CODE, _BACK = _profile()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@functools.lru_cache(maxsize=256)
def _head(rows: int) -> bytes:
    return (
        SOI
        + _segment(0xDB, b"\0" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + b"\1\x11\0")
        + _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS)
        + _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS)
        + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def encode_frame(samples: np.ndarray) -> bytes:
    """samples: uint8, rows x 64."""
    level = samples.reshape(-1).astype(np.int16)
    words = _CODE[np.diff(level, prepend=np.int16(128)) + 255] << np.uint64(1)
    w = words.reshape(-1, 4)
    packed = (w[:, 0] << np.uint64(30)) | (w[:, 1] << np.uint64(20)) | (w[:, 2] << np.uint64(10)) | w[:, 3]
    scan = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    return _head(samples.shape[0]) + scan.replace(b"\xff", b"\xff\0") + EOI


#: Place in the block of each coefficient: diagonals, in turn upwards and downwards.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@functools.lru_cache(maxsize=16)
def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code fits."""
    out, code, at = [(0, 0)] * 65536, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            low, wide = code << (16 - n), 1 << (16 - n)
            if low + wide > 65536 or at >= len(symbols):
                raise ValueError("broken Huffman table")
            out[low : low + wide] = [(n, symbols[at])] * wide
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _coefficients(scan: bytes, order: list[tuple[int, list, list]], units: int, parts: int) -> list[list[list[int]]]:
    """Blocks of 64 coefficients by component.  order: (component, DC table, AC table) of each block of a unit."""
    out: list[list[list[int]]] = [[] for _ in range(parts)]
    before, held, bits, at = [0] * parts, 0, 0, 0

    def peek(n: int) -> int:
        nonlocal held, bits, at
        while bits < n:
            held, bits, at = held << 8 | (scan[at] if at < len(scan) else 255), bits + 8, at + 1
        return held >> (bits - n) & ((1 << n) - 1)

    def skip(n: int) -> None:
        nonlocal held, bits
        bits -= n
        held &= (1 << bits) - 1

    def symbol(table) -> int:
        n, found = table[peek(16)]
        if not n or at > len(scan) + 8:
            raise ValueError("broken scan")
        skip(n)
        return found

    def number(n: int) -> int:
        if not n:
            return 0
        v = peek(n)
        skip(n)
        return v if v >> (n - 1) else v - (1 << n) + 1

    for _ in range(units):
        for part, dc, ac in order:
            block, k = [0] * 64, 1
            before[part] += number(symbol(dc))
            block[0] = before[part]
            while k < 64:
                rs = symbol(ac)
                if rs == 0:
                    break
                k += rs >> 4
                if rs & 15 and k < 64:
                    block[k] = number(rs & 15)
                k += 1
            out[part].append(block)
    return out


def _picture(segments: list[bytes], size: tuple[int, int], parts: list[tuple[int, int, int, int]], quants: dict, tables: dict, chosen: dict, interval: int) -> np.ndarray:
    """The brightness pixels, from the first component.  parts: (id, columns and rows of blocks in a unit, quantiser)."""
    across, down = (1, 1) if len(parts) == 1 else (max(p[1] for p in parts), max(p[2] for p in parts))
    wide, high = -(-size[1] // (8 * across)), -(-size[0] // (8 * down))
    order = []
    for i, (name, h, v, _) in enumerate(parts):
        dc, ac = (_lookup(*tables[k]) for k in (chosen[name] >> 4, 16 | chosen[name] & 15))
        order += [(i, dc, ac)] * (1 if len(parts) == 1 else h * v)
    left, blocks = wide * high, []
    for segment in segments:
        units = min(left, interval or left)
        blocks += _coefficients(segment.replace(b"\xff\0", b"\xff"), order, units, len(parts))[0]
        left -= units
    if left:
        raise ValueError("broken scan")
    h, v = (1, 1) if len(parts) == 1 else parts[0][1:3]
    values = np.zeros((len(blocks), 64))
    values[:, _ZIGZAG] = np.array(blocks) * quants[parts[0][3]]
    pixels = np.einsum("ux,nuv,vy->nxy", _COSINES, values.reshape(-1, 8, 8), _COSINES) + 128
    plane = pixels.reshape(high, wide, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * v * 8, wide * h * 8)
    rows, columns = -(-size[0] * v // down), -(-size[1] * h // across)
    return np.clip(np.floor(plane[:rows, :columns] + 0.5), 0, 255).astype(np.uint8)


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The picture of a baseline frame, uint8: block levels of flat-block frames as written here, else brightness pixels."""
    if jpeg[:2] != SOI:
        raise ValueError("not a JPEG frame")
    at, tables, quants, size, parts, chosen, interval = 2, {}, {}, None, [], {}, 0
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 255:
            raise ValueError("broken JPEG frame")
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide].ljust(64 * wide, b"\1"), ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            precision, *size, n_parts = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_parts)]
            if precision != 8 or 0 in size or not parts or any(not 0 < x < 5 for p in parts for x in p[1:3]):
                raise ValueError("not an 8-bit frame")
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            interval = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    end = jpeg.rfind(EOI)
    scan = jpeg[at : end if end >= at else len(jpeg)]
    if size is None or any(p[0] not in chosen or p[3] not in quants for p in parts) or any(k not in tables for c in chosen.values() for k in (c >> 4, 16 | c & 15)):
        raise ValueError("broken JPEG frame")
    rows, columns = -(-size[0] // 8), -(-size[1] // 8)
    flat = len(parts) == 1 and tables[0] == (DC_COUNTS, DC_SYMBOLS) and tables[16] == (AC_COUNTS, AC_SYMBOLS) and rows * columns % 4 == 0 and not interval
    packed = scan.replace(b"\xff\0", b"\xff") if flat else b""
    if not flat or len(packed) != rows * columns * 5 // 4:
        return _picture(re.split(rb"\xff[\xd0-\xd7]", scan), tuple(size), parts, quants, tables, chosen, interval)
    wide = np.zeros((rows * columns // 4, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    four = wide.view(">u8").astype(np.uint64)[:, 0]
    words = np.stack([(four >> np.uint64(shift)) & np.uint64(511) for shift in (31, 21, 11, 1)], 1)
    levels = np.cumsum(_BACK[words.reshape(-1)], dtype=np.int32) * (int(quants[parts[0][3]][0]) / 8)
    return np.clip(np.floor(levels + 128.5), 0, 255).astype(np.uint8).reshape(rows, columns)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """payload: a positive multiple of 64 bytes; its length is kept in an INFO chunk, so the last frame may be padded."""
    rows = min(ROWS, len(payload) // UNIT)
    per = rows * UNIT
    frames = -(-len(payload) // per)
    samples = np.frombuffer(payload + bytes(frames * per - len(payload)), np.uint8).reshape(frames, rows, UNIT)
    movi, index, at = [b"movi"], [], 4
    for f in range(frames):
        chunk = _chunk(b"00dc", jpeg := encode_frame(samples[f]))
        index.append(struct.pack("<4sIII", b"00dc", 16, at, len(jpeg)))
        movi.append(chunk)
        at += len(chunk)
    width, height = UNIT * 8, rows * 8
    largest = max(len(x) for x in movi)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(len(payload)).encode() + b"\0"))
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_frames(avi: bytes) -> tuple[list[bytes], float, int | None]:
    """The frames' JPEG data by the index, frames a second, and the payload's length if the file tells it."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, length, movi, index = float(FPS), None, None, None

    def parts(lo: int, hi: int):
        while lo + 8 <= hi:
            name, n = avi[lo : lo + 4], struct.unpack_from("<I", avi, lo + 4)[0]
            yield name, lo + 8, min(hi, lo + 8 + n)
            lo += 8 + n + n % 2

    todo = [(12, len(avi))]
    while todo:
        for name, lo, hi in parts(*todo.pop()):
            if name == b"LIST" and avi[lo : lo + 4] == b"movi":
                movi = (lo, hi)
            elif name == b"LIST":
                todo.append((lo + 4, hi))
            elif name == b"strh" and avi[lo : lo + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", avi, lo + 20)
                fps = rate / scale if scale else fps
            elif name == b"ICMT" and avi[lo:hi].rstrip(b"\0").isdigit():
                length = int(avi[lo:hi].rstrip(b"\0"))
            elif name == b"idx1":
                index = (lo, hi)
    if movi is None or fps <= 0:
        raise ValueError("no movi list, or no frame rate")
    if index:
        entries = [struct.unpack_from("<4sIII", avi, x) for x in range(index[0], index[1] - 15, 16)]
        base = movi[0] if not entries or avi[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        frames = [avi[base + at + 8 : base + at + 8 + n] for name, _, at, n in entries if name[2:] in (b"dc", b"db")]
    else:
        frames = [avi[lo:hi] for name, lo, hi in parts(movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return frames, fps, length


def shots(levels: list[np.ndarray], fps: float, k: float = 3.0, floor: float = 0.25, memory: int = 8) -> list[tuple[int, int, float, float, float]]:
    """Timed clips: (first frame, end frame, start s, end s, mean level)."""
    if not levels:
        return []
    hist = [np.bincount(x.reshape(-1) >> 3, minlength=32) / x.size for x in levels]
    cuts, recent = [0], []
    for i in range(1, len(hist)):
        d = float(np.abs(hist[i] - hist[i - 1]).sum()) / 2
        if d > floor and (not recent or d > np.mean(recent) + k * np.std(recent)):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[-memory + 1 :], d]
    return [(a, b, a / fps, b / fps, float(np.mean([levels[f].mean() for f in range(a, b)]))) for a, b in zip(cuts, [*cuts[1:], len(levels)], strict=True)]


def payload_of(avi: bytes) -> tuple[bytes, list[np.ndarray], float]:
    frames, fps, length = read_frames(avi)
    levels = [decode_frame(f) for f in frames]
    return b"".join(x.tobytes() for x in levels)[:length], levels, fps


def _kind(table: DataFrame) -> str:
    return table.schema["doc_id"].dataType.simpleString()


def _read(media: bytes | None) -> tuple[bytes, list[np.ndarray], float] | None:
    """What a file holds, or None where it is null or can't be read."""
    try:
        return None if media is None else payload_of(media)
    except (ValueError, IndexError, struct.error):  # IndexError: a file cut inside a segment
        return None


def _store(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        lo = 0
        while lo < len(texts):  # a few megabytes of files at a time
            part: list[bytes] = []
            while lo + len(part) < len(texts) and sum(map(len, part)) < STORE_BYTES and len(part) < 256:
                part.append(texts[lo + len(part)].as_py() or b"")
            media = [write_avi(x + bytes(-len(x) % UNIT or (0 if x else UNIT))) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
            lo += len(part)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a lossless AVI file."""
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {_kind(docs)}, n_bytes bigint, media binary")


def _digest(batches):
    for batch in batches:
        rows = []
        for media in batch.column(2):
            avi = media.as_py()
            read = _read(avi)
            stored = (None, None) if avi is None else (len(avi), hashlib.sha256(avi).hexdigest())
            if read is None:
                rows.append((None, None, None, *stored, None if avi is None else "broken"))
                continue
            payload, levels, fps = read
            clips = shots(levels, fps)
            cuts = ";".join(f"{a}-{b}@{m:.3f}" for a, b, _, _, m in clips)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, f"frames={len(levels)} rows={len(payload) // UNIT} shots={len(clips)} clips={cuts}"))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_bytes", *names])


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of a (doc_id, n_bytes, media) table, from the stored bytes alone."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, f"doc_id {_kind(media)}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def _clips(batches):
    for batch in batches:
        ids, rows = [], []
        for i, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, levels, fps = _read(media.as_py()) or (b"", [], FPS)
            for shot, clip in enumerate(shots(levels, fps)):
                ids.append(i)
                rows.append((shot, *clip))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))], names=["doc_id", "shot", "first_frame", "end_frame", "start_s", "end_s", "mean_level"])


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of a media column; null media give none."""
    return media.select("doc_id", F.col("media")).mapInArrow(_clips, f"doc_id {_kind(media)}, shot int, first_frame int, end_frame int, start_s double, end_s double, mean_level double")
