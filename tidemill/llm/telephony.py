"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM in WAV, PCM by lookup tables and numpy.

The stored form is a binary column of a table in the shared folder: a RIFF/WAVE file per row. Readers
get the payload back as bytes, or as 16-bit PCM, resampled by linear interpolation and stored as a
column of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, portions

# WAVE format tags, and the index steps of IMA ADPCM.
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima": 17}
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)


def _mulaw() -> np.ndarray:
    """G.711 mu-law by its rule: inverted byte, sign, three bits of exponent, four of mantissa."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    """G.711 A-law by its rule: even bits inverted, sign bit set for positive values."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def _steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: each a tenth more than the one before, in whole numbers."""
    steps = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(steps, np.int64)


MULAW, ALAW, STEPS = _mulaw(), _alaw(), _steps()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM mono blocks (one per row): the loop runs over samples, numpy over all blocks.

    A block is predictor (int16), step index (byte), a zero byte, then two samples a byte, low half first.
    """
    count, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.clip(blocks[:, 2].astype(np.int64), 0, 88)
    out = np.empty((1 + 2 * (width - 4), count), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        code = (codes[k // 2] >> (4 * (k & 1))).astype(np.int64) & 15
        step = STEPS[index]
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def wave(samples: bytes, codec: str = "mulaw", rate: int = 8000, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file; ``block`` is the bytes of an ADPCM block, else one byte a sample."""
    tag = FORMATS[codec]
    bits = {"pcm": 16, "ima": 4}.get(codec, 8)
    align = 2 if codec == "pcm" else block
    per = 1 + 2 * (block - 4) if codec == "ima" else 1
    extra = struct.pack("<H", per) if codec == "ima" else b""
    count = len(samples) // align * per
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * align // per, align, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, block bytes, sample bytes) of a RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, head, data = 12, None, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    codec = {v: k for k, v in FORMATS.items()}[head[0]]
    return codec, head[2], head[4], data


def payload(codec: str, block: int, samples: bytes) -> bytes:
    """What a file carries: all bytes of its samples, but for the headers of ADPCM blocks."""
    return np.frombuffer(samples, np.uint8).reshape(-1, block)[:, 4:].tobytes() if codec == "ima" else samples


def packed(data: bytes, codec: str, rate: int, unit: int) -> bytes:
    """A file that carries ``data``, a multiple of ``unit`` bytes: samples as they are, or ADPCM blocks of ``unit`` bytes that start from silence."""
    if codec != "ima":
        return wave(data, codec, rate)
    blocks = np.frombuffer(data, np.uint8).reshape(-1, unit)
    return wave(np.concatenate((np.zeros((len(blocks), 4), np.uint8), blocks), axis=1).tobytes(), codec, rate, unit + 4)


def expanded(files: list[tuple[str, int, int, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of (codec, rate, block, samples): tables for 8-bit samples, one decoding for all ADPCM blocks of a width."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    wide: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, (codec, _, block, samples) in enumerate(files):
        if codec == "ima":
            wide.setdefault(block, []).append((k, np.frombuffer(samples, np.uint8).reshape(-1, block)))
        else:
            out[k] = np.frombuffer(samples, "<i2") if codec == "pcm" else (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(samples, np.uint8)]
    for some in wide.values():
        decoded, at = adpcm(np.concatenate([b for _, b in some])), 0
        for k, b in some:
            out[k] = decoded[at : at + len(b)].ravel()
            at += len(b)
    return out


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate; the last sample is held."""
    if rate == to or not len(x):
        return x
    if to == 2 * rate:  # midpoints, without divisions
        out = np.empty(2 * len(x), np.int16)
        out[::2] = x
        out[1:-1:2] = (x[:-1].astype(np.int32) + x[1:]) >> 1
        out[-1] = x[-1]
        return out
    n = len(x) * to // rate
    place = np.arange(n, dtype=np.int64) * rate
    left = place // to
    right = np.minimum(left + 1, len(x) - 1)
    share = place - left * to
    return ((x[left].astype(np.int64) * (to - share) + x[right].astype(np.int64) * share) // to).astype(np.int16)


def folded(x: np.ndarray) -> bytes:
    """PCM for storage, without loss: every second sample, then the others as their distance from the middle of their neighbours.

    What doubling the rate adds is a row of zeros then, which compresses to nothing.
    """
    even, odd = x[::2], x[1::2]
    return np.concatenate((even, (odd - middles(even, len(odd))).astype(np.int16))).astype("<i2").tobytes()


def unfolded(data: bytes | np.ndarray) -> np.ndarray:
    """The PCM that ``folded`` was given."""
    x = np.frombuffer(data, "<i2")
    out, even = np.empty(len(x), "<i2"), x[: (len(x) + 1) // 2]
    out[::2] = even
    out[1::2] = (x[len(even) :] + middles(even, len(x) // 2)).astype(np.int16)
    return out


def coded(sounds: list[np.ndarray]) -> list[bytes]:
    """Samples for storage, without loss: the 255 commonest values of all the sounds take a byte each, others a byte and two more at the end.

    Each result is the number of those values, the number of samples, the values, the bytes, and the other samples.
    """
    count = np.zeros(1 << 16, np.int64)
    for x in sounds:
        count += np.bincount(x.view("<u2"), minlength=1 << 16)
    common = np.sort(np.argsort(-count, kind="stable")[: min(255, np.count_nonzero(count))])
    table = np.full(1 << 16, 255, np.uint8)
    table[common] = np.arange(len(common))
    out = []
    for x in sounds:
        codes = table[x.view("<u2")]
        out.append(struct.pack("<HI", len(common), len(x)) + common.astype("<u2").tobytes() + codes.tobytes() + x[codes == 255].tobytes())
    return out


def decoded(data: bytes) -> np.ndarray:
    """The samples of one result of ``coded``."""
    size, n = struct.unpack_from("<HI", data)
    values = np.zeros(256, "<i2")
    values[:size] = np.frombuffer(data, "<i2", size, 6)
    codes = np.frombuffer(data, np.uint8, n, 6 + 2 * size)
    out = values[codes]
    out[codes == 255] = np.frombuffer(data, "<i2", offset=6 + 2 * size + n)
    return out


def restored(data: bytes) -> np.ndarray:
    """The PCM of a stored value."""
    return unfolded(decoded(data))


def middles(even: np.ndarray, count: int) -> np.ndarray:
    """The middle of each sample and the next one; the last one stands for itself."""
    return (even[:count].astype(np.int32) + np.append(even[1:], even[-1:])[:count]) >> 1


def features(x: np.ndarray, rate: int) -> str:
    """Samples, seconds, root mean square, peak, mean and sign changes of PCM, in whole numbers and thousandths."""
    n = len(x)
    if not n:
        return "n=0"
    wide = x.astype(np.int64)
    square = int(np.dot(wide, wide))
    low, high = int(x.min()), int(x.max())
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rate={rate};n={n};s={n / rate:.3f};rms={(square / n) ** 0.5:.3f};peak={max(-low, high)};mean={int(wide.sum()) / n:.3f};turns={turns}"


CODECS = ("mulaw", "alaw", "ima")

#: Level of zstd for stored media, and bytes that are compressed together: they are written once and large.
LEVEL, PAGE = 9, 4 << 20


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None, rate: int = 8000, unit: int = 192) -> DataFrame:
    """Store each text's UTF-8 as a media column, and return the table as read back.

    The bytes, with bytes 32 appended up to a positive multiple of ``unit``, are stored losslessly: as the
    8-bit samples of a "mulaw" or "alaw" file, or as the codes of "ima" blocks. Without a ``codec`` the
    payload's CRC-32 picks one of the three, so that equal texts have equal files. Returns (id, n_bytes,
    media). A null text counts as empty: one unit of bytes 32. Repeated and null ids keep their rows;
    other columns are not read; an empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def one(raw: bytes) -> bytes:
        data = raw + b" " * ((-len(raw)) % unit if raw else unit)
        return packed(data, codec or CODECS[zlib.crc32(data) % len(CODECS)], rate, unit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            texts = batch.column(1).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([one(t) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text"))
    return cut(rows.mapInArrow(work, f"`{id_col}` {kind}, n_bytes long, media binary"), "media", LEVEL, PAGE)


def to_pcm(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", tail: int = 16, to: int = 16000) -> DataFrame:
    """Every media value expanded, resampled and stored; the table as read back.

    Returns (id, payload_bytes, payload_sha256, tail_crc32 of the last ``tail`` payload bytes, media_bytes,
    media_sha256, rate, pcm binary of little-endian 16-bit samples). A null media value gives nulls.
    """
    stored = stored_pcm(df, id_col, media_col, tail, to)
    schema, at = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields), len(stored.columns) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at):
            sound = [None if x is None else restored(x).tobytes() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sound, pa.binary())], names=batch.schema.names)

    return stored.mapInArrow(work, schema)


def stored_pcm(df: DataFrame, id_col: str, media_col: str, tail: int, to: int) -> DataFrame:
    """``to_pcm`` with the samples as they are stored, ``folded`` and ``coded``; rows of one codec lie together, as they are alike."""
    kind = df.schema[id_col].dataType.simpleString()
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "rate", "pcm"]

    def row(media: bytes, file: tuple[str, int, int, bytes], pcm: bytes) -> tuple:
        data = payload(file[0], file[2], file[3])
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-tail:]), len(media), hashlib.sha256(media).hexdigest(), to, pcm

    def rows(media: list[bytes], files: list[tuple[str, int, int, bytes]]) -> list[tuple]:
        sounds = [np.frombuffer(folded(resample(x, file[1], to)), "<i2") for x, file in zip(expanded(files), files)]
        return list(map(row, media, files, coded(sounds)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            media = batch.column(1).to_pylist()
            files = [None if m is None else read_wave(m) for m in media]
            for codec in (None, *FORMATS):
                at = [k for k, file in enumerate(files) if (file and file[0]) == codec]
                if at:
                    out = rows([media[k] for k in at], [files[k] for k in at]) if codec else [(None,) * len(names)] * len(at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=[id_col, *names])

    out = f"`{id_col}` {kind}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, rate int, pcm binary"
    return cut(df.select(F.col(id_col), F.col(media_col)).mapInArrow(work, out), "pcm", LEVEL, PAGE)


def plain(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2")


def describe(sounds: DataFrame, pcm_col: str = "pcm", rate_col: str = "rate", read: Callable[[bytes], np.ndarray] = plain) -> DataFrame:
    """The rows of a table with stored PCM, with a feature string in place of the samples, which ``read`` gets from the
    column's bytes; null samples give null."""
    names = sounds.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, names.index(pcm_col)):
            values = zip(batch.column(names.index(pcm_col)).to_pylist(), batch.column(names.index(rate_col)).to_pylist())
            found = [None if x is None else features(read(x), rate) for x, rate in values]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names if n != pcm_col] + [pa.array(found, pa.string())], names=[n for n in names if n != pcm_col] + ["feature"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sounds.schema.fields if f.name != pcm_col)
    return sounds.mapInArrow(work, f"{kept}, feature string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: int = 2000) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): store, expand to PCM of ``to`` Hz,
    store that, and describe what is read back. ``n_bytes`` is the unpadded length, from the text itself."""
    media = store(df, id_col, text_col)
    sounds = stored_pcm(media.select(F.struct(id_col, "n_bytes").alias("__row"), "media"), "__row", "media", 16, to)
    return describe(sounds, read=restored).select(f"__row.{id_col}", "__row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
