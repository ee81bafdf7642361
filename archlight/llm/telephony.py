"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV containers, expanded to resampled PCM.

Companded samples are expanded by 256-entry lookup tables, which a rule builds. ADPCM blocks are decoded with numpy
across all blocks of a batch of files: the loop runs over the samples of a block, each step handles one sample of every
block. Resampling is by a windowed-sinc interpolator with fixed integer taps, so that results are the same on every
machine.

``store_bytes`` keeps any payload losslessly as 8-bit samples of one of three forms, which a checksum of the payload
chooses: mu-law, A-law, or the codes of ADPCM blocks of ``BLOCK`` bytes behind blank block heads. ``read_media`` parses
stored files, gives the payload back and computes features from the resampled PCM. Null text counts as empty and still
gives 64 samples; equal texts give equal files. A text may be of any length. A file that is no WAV of a known kind
gives a null payload and the feature ``unreadable``. Rows keep their multiplicity, ``doc_id`` may be null and other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batch, map_arrow, texts_of

BLOCK = 64
RATE = 8_000
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", ADPCM: "adpcm"}
FORMS = (MULAW, ALAW, ADPCM)
#: A block's head: its first sample and step index, both 0 where a payload is stored.
HEAD = b"\0" * 4
#: Bytes of media that a task expands at once; their PCM is up to eight times as long.
AT_ONCE = 1 << 18
#: Fixed values of IMA ADPCM: index changes for the low three bits of a code; step sizes grow by a tenth from 7 and are listed in the standard.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int64)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int64,
)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, step + 8, step + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def wav(kind: int, rate: int, data: bytes, bits: int = 8, align: int = 1, extra: bytes = b"") -> bytes:
    """A mono WAV file."""
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * align, align, bits) + (struct.pack("<H", len(extra)) + extra if kind != PCM else b"")
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"data", data)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, bytes] | None:
    """Kind, rate, block size and data of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        chunk = media[at + 8 : at + 8 + size]
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", chunk)
        elif name == b"data":
            data = chunk
        at += 8 + size + size % 2
    if fmt is None or data is None or fmt[0] not in NAMES or fmt[1] != 1:
        return None
    return fmt[0], fmt[2], fmt[4], data


def decode_adpcm(data: bytes, align: int) -> np.ndarray:
    """Samples of IMA ADPCM blocks: a header with the first sample and the step index, then two codes in a byte."""
    if align <= 4 or len(data) < align:
        return np.zeros(0, np.int16)
    blocks = np.frombuffer(data[: len(data) // align * align], np.uint8).reshape(-1, align)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.clip(blocks[:, 2].astype(np.int64), 0, 88)
    body = blocks[:, 4:]
    codes = np.stack((body & 15, body >> 4), axis=2).reshape(len(blocks), -1).astype(np.int64)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k], STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def encode_adpcm(samples: np.ndarray, align: int = 256) -> bytes:
    """IMA ADPCM blocks; the last one is filled up with its last sample."""
    per = 2 * (align - 4) + 1
    x = np.asarray(samples, np.int64)
    if not len(x):
        return b""
    x = np.concatenate([x, np.repeat(x[-1:], -len(x) % per)]).reshape(-1, per)
    value, index = x[:, 0].copy(), np.zeros(len(x), np.int64)
    codes = np.empty((len(x), per - 1), np.uint8)
    for k in range(per - 1):
        step, gap = STEPS[index], x[:, k + 1] - value
        code, left, change = np.where(gap < 0, 8, 0), np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= part
            code, left, change = code + bit * take, left - part * take, change + part * take
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
        codes[:, k] = code
    head = np.zeros((len(x), 4), np.uint8)
    head[:, :2] = x[:, 0].astype("<i2").reshape(-1, 1).view(np.uint8).reshape(-1, 2)
    return np.hstack((head, codes[:, 0::2] | codes[:, 1::2] << 4)).tobytes()


def expand(kind: int, align: int, data: bytes) -> np.ndarray:
    """16-bit samples of stored data."""
    if kind == MULAW:
        return MULAW_PCM[np.frombuffer(data, np.uint8)]
    if kind == ALAW:
        return ALAW_PCM[np.frombuffer(data, np.uint8)]
    if kind == ADPCM:
        return decode_adpcm(data, align)
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2")


def expand_all(parsed: list[tuple[int, int, int, bytes] | None]) -> list[np.ndarray | None]:
    """The samples of several files; ADPCM blocks of one size are decoded across all of them."""
    out = [None if p is None or p[0] == ADPCM else expand(p[0], p[2], p[3]) for p in parsed]
    for align in {p[2] for p in parsed if p and p[0] == ADPCM}:
        own = [i for i, p in enumerate(parsed) if p and p[0] == ADPCM and p[2] == align]
        whole = [parsed[i][3][: len(parsed[i][3]) // max(align, 1) * align] for i in own]
        samples, at = decode_adpcm(b"".join(whole), align), 0
        for i, data in zip(own, whole):
            n = len(data) // align * (2 * (align - 4) + 1) if align > 4 else 0
            out[i], at = samples[at : at + n], at + n
    return out


def payload_in(kind: int, align: int, data: bytes) -> bytes:
    """The bytes that a file stores: its samples, or the codes of its blocks without their heads."""
    if kind != ADPCM or align <= 4:
        return data
    return np.frombuffer(data[: len(data) // align * align], np.uint8).reshape(-1, align)[:, 4:].tobytes()


def resample(x: np.ndarray, up: int = 2, half: int = 4) -> np.ndarray:
    """``up`` times as many samples; the given ones stay, those between come from a windowed sinc with integer taps."""
    if up == 1 or not len(x):
        return x.astype(np.int16)
    padded = np.pad(x.astype(np.int32), half, mode="edge")
    out = np.empty((len(x), up), np.int16)
    out[:, 0] = x
    at = np.arange(-half + 1, half + 1)
    for phase in range(1, up):
        d = at - phase / up
        taps = np.sinc(d) * np.cos(np.pi * d / (2 * half)) ** 2
        taps = np.rint(taps / taps.sum() * 16384).astype(np.int64)
        taps[half - 1] += 16384 - taps.sum()
        total = np.zeros(len(x), np.int32)
        for tap, shift in zip(taps.tolist(), at.tolist()):
            total += (padded[half + shift : half + shift + len(x)] * np.int32(tap)) >> 2
        out[:, phase] = np.clip(total >> 12, -32768, 32767)
    return out.reshape(-1)


def convert(x: np.ndarray, own: int, rate: int, half: int = 4) -> np.ndarray:
    """Samples at ``own`` as samples at ``rate``, up or down by the reduced ratio; by ``resample`` where that is whole.

    Sample n of the result lies at n * own / rate. Going down, the windowed sinc is as much wider as its band is narrower.
    """
    if rate % own == 0 or not len(x):
        return resample(x, max(1, rate // own), half)
    common = math.gcd(own, rate)
    up, down = rate // common, own // common
    wide = max(1.0, down / up)
    reach = math.ceil(half * wide)
    padded = np.pad(x.astype(np.int64), reach, mode="edge")
    at = np.arange(-reach + 1, reach + 1)
    n = -(-len(x) * up // down)
    out = np.empty(n, np.int16)
    step = max(1, (1 << 18) // len(at))
    for begin in range(0, n, step):
        base, phase = np.divmod(np.arange(begin, min(n, begin + step), dtype=np.int64) * down, up)
        phases, which = np.unique(phase, return_inverse=True)
        d = (at - (phases / up)[:, None]) / wide
        taps = np.where(np.abs(d) < half, np.sinc(d) * np.cos(np.pi * d / (2 * half)) ** 2, 0)
        taps = np.rint(taps / taps.sum(axis=1, keepdims=True) * 16384).astype(np.int64)
        taps[:, reach - 1] += 16384 - taps.sum(axis=1)
        total = (padded[base[:, None] + (reach + at)] * taps[which]).sum(axis=1)
        out[begin : begin + step] = np.clip(total >> 14, -32768, 32767)
    return out


def features(kind: int, rate: int, pcm: np.ndarray) -> str:
    """Level, peak, sign changes and a checksum of PCM samples, in whole numbers."""
    wide = pcm.astype(np.int64)
    level = int(np.sqrt(int((wide * wide).sum()) // max(1, len(wide))))
    peak = int(np.abs(wide).max(initial=0))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{NAMES[kind]};rate={rate};samples={len(pcm)};rms={level};peak={peak};turns={turns};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b"\0" * (BLOCK if not raw else -len(raw) % BLOCK)


def stored(payload: bytes, kind: int | None = None) -> bytes:
    """A payload as a file, of the form that its checksum chooses if none is asked for."""
    kind = FORMS[zlib.crc32(payload) % len(FORMS)] if kind is None else kind
    if kind != ADPCM:
        return wav(kind, RATE, payload)
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    heads = np.zeros((len(blocks), len(HEAD)), np.uint8)
    return wav(ADPCM, RATE, np.hstack((heads, blocks)).tobytes(), 4, BLOCK + len(HEAD), struct.pack("<H", 2 * BLOCK + 1))


def store_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's bytes, filled up to whole blocks, as the samples of a WAV file."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [payload_of(t) for t in texts_of(b.column(1))]
            yield batch(out, {"doc_id": b.column(0), "n_bytes": [n for n, _ in found], "media": [stored(p) for _, p in found]})

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), work, "doc_id long, n_bytes long, media binary")


def read_media(files: DataFrame, rate: int = 16_000, keep_pcm: bool = False) -> DataFrame:
    """The stored samples read back, and features of their PCM at ``rate``; with ``keep_pcm`` that PCM as a WAV file too."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    out = pa.schema(fields + [("pcm", pa.binary())] * keep_pcm)

    def read(media: bytes | None, got: tuple | None, samples: np.ndarray | None) -> tuple:
        if got is None:
            return None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), "unreadable", None
        kind, own, align, data = got
        pcm, at, payload = convert(samples, own, rate) if own else samples, rate if own else 0, payload_in(kind, align, data)
        kept = wav(PCM, at, pcm.astype("<i2").tobytes(), 16, 2) if keep_pcm else None
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(kind, at, pcm), kept

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        begin, size = 0, 0
        for i, n in enumerate(pc.binary_length(b.column(2)).to_pylist()):
            if size + (n or 0) > AT_ONCE and i > begin:
                yield b.slice(begin, i - begin)
                begin, size = i, 0
            size += n or 0
        yield b.slice(begin)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")
        for whole in batches:
            for b in parts(whole):
                media = b.column(2).to_pylist()
                parsed = [parse(m) if m is not None else None for m in media]
                found = list(zip(*map(read, media, parsed, expand_all(parsed)))) or [[]] * 7
                yield batch(out, {"doc_id": b.column(0), "n_bytes": b.column(1)} | {k: list(v) for k, v in zip(names, found)})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(files.select("doc_id", "n_bytes", "media"), work, schema + ", pcm binary" * keep_pcm)
