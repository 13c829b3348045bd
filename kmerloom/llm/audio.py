"""Audio features of byte payloads.

A payload is stored losslessly as a WAV file of unsigned 8-bit samples, read back, resampled by a polyphase filter (16 kHz to 12,
three phases), cut into overlapping frames and turned into log-mel energies. The energies are dealt into fixed-shape tensors (an Arrow
stream with a fixed_shape_tensor column) with their time spans, and an energy threshold with hysteresis gives the segments that
are loud. Everything is worked out per row, so there is no shuffle and no state, and block by block of frames, so that a long
payload needs little more than what is stored of it.

Defined cases: a null text is empty; an empty text has a payload of 64 zero bytes, hence one frame; equal texts give equal values;
null and repeated ids are rows like others; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from . import common

UNIT = 64
RATE = 16_000
#: Resampling by UP / DOWN with TAPS filter taps per phase.
UP, DOWN, TAPS = 3, 4, 16
#: Frames of FRAME samples, HOP apart, MELS filters, WINDOW frames in a tensor.
FRAME, HOP, MELS, WINDOW = 256, 128, 32, 32
#: Frames worked on at once.
BLOCK = 4096
#: A segment opens above OPEN and closes below CLOSE, in decibels over the payload's mean energy.
OPEN, CLOSE = 1.0, -1.0


def padded(text: bytes) -> bytes:
    return text + bytes(UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; an odd length gets the pad byte that the format asks for."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + bytes(pad)


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples; walks the chunks, so files with further chunks can be read."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono PCM of 8 bits")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def polyphase_filter(up: int, down: int, taps: int) -> np.ndarray:
    """Phases by taps of a Hann-windowed low-pass at the lower of the two rates; each phase sums to 1."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    phases = h.reshape(taps, up).T[:, ::-1]
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resampled_size(n: int, up: int = UP, down: int = DOWN) -> int:
    return -(-n * up // down)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Samples start to stop. Sample m is phase m * down mod up of the filter over the taps around m * down / up; no zeros are stuffed."""
    phases = polyphase_filter(up, down, taps)
    stop = resampled_size(len(x), up, down) if stop is None else stop
    out = np.zeros(max(0, stop - start), np.float32)
    low = start * down // up - taps // 2
    high = stop * down // up + taps
    wide = np.zeros(high - low, np.float32)
    inside = slice(max(0, low), max(0, min(len(x), high)))
    wide[inside.start - low : inside.start - low + len(x[inside])] = x[inside]
    for first in range(min(up, len(out))):
        phase, base = (start + first) * down % up, (start + first) * down // up - taps // 2 - low
        mine = out[first::up]
        for k in range(taps):
            mine += phases[phase, k] * wide[base + k :: down][: len(mine)]
    return out


@lru_cache
def mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0.0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / np.diff(edges)[:-1]
    fall = (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def frame_count(samples: int) -> int:
    return max(1, -(-(samples - FRAME) // HOP) + 1)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Frames by mels in decibels, and the energy of each frame; the last frame is filled up with zeros."""
    frames = frame_count(len(x))
    x = np.concatenate([x, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(x)), np.float32)])
    cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:frames] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(cut, axis=1)).astype(np.float32) ** 2
    return 10 * np.log10(power @ mel_bank(rate, FRAME, MELS) + 1e-6), power.mean(axis=1)


def features(samples: np.ndarray, rate: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """log_mel of the resampled payload (unsigned 8-bit samples), `block` frames at a time."""
    size = resampled_size(len(samples))
    frames = frame_count(size)
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, block):
        b = min(frames, a + block)
        low, high = a * HOP, min(size, (b - 1) * HOP + FRAME)
        first = max(0, low * DOWN // UP - TAPS)
        first -= first % DOWN  # so that phases stay where they are
        last = min(len(samples), high * DOWN // UP + 2 * TAPS)
        part = (samples[first:last].astype(np.float32) - 128) / 128
        shift = first * UP // DOWN
        mel[a:b], energy[a:b] = log_mel(resample(part, start=low - shift, stop=high - shift), rate)
    return mel, energy


def segments(energy: np.ndarray, opens: float = OPEN, closes: float = CLOSE) -> list[tuple[int, int]]:
    """Half-open runs of frames: from one louder than `opens` to the next quieter than `closes` (dB over the mean)."""
    level = 10 * np.log10((energy + 1e-9) / (energy.mean() + 1e-9))
    marks = np.where(level > opens, 1, np.where(level < closes, -1, 0))
    known = np.flatnonzero(marks)
    last = np.zeros(len(marks), int)
    last[known] = known
    state = (marks[np.maximum.accumulate(last)] == 1).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tensors(mel: np.ndarray, rate: float) -> bytes:
    """An Arrow stream of (start_s, end_s, mel): tensors of WINDOW x MELS, the last one filled up with zeros."""
    import pyarrow as pa

    sink, writer = pa.BufferOutputStream(), None
    for a in range(0, len(mel), BLOCK):
        part = mel[a : a + BLOCK]
        n = -(-len(part) // WINDOW)
        full = np.zeros((n, WINDOW, MELS), np.float32)
        full.reshape(-1, MELS)[: len(part)] = np.round(part, 2)
        start = (a + np.arange(n) * WINDOW) * HOP / rate
        end = np.minimum(start + ((WINDOW - 1) * HOP + FRAME) / rate, ((len(mel) - 1) * HOP + FRAME) / rate)
        batch = pa.record_batch({"start_s": pa.array(start), "end_s": pa.array(end), "mel": pa.FixedShapeTensorArray.from_numpy_ndarray(full)})
        writer = writer or pa.ipc.new_stream(sink, batch.schema)
        writer.write_batch(batch)
    writer.close()
    return sink.getvalue().to_pybytes()


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Per row: the id, the digests of payload and media, feature; with full also media, tensors and loud spans."""

    def per_slice(batch):
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media", "tensors", "spans"] * full
        rows: dict[str, list] = {n: [] for n in names}
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            media = write_wav(padded(raw))
            rate, payload = read_wav(media)
            slow = rate * UP / DOWN
            mel, energy = features(np.frombuffer(payload, np.uint8), slow)
            loud, stored = segments(energy), tensors(mel, slow)
            feature = f"frames={len(mel)};mels={MELS};tensors={-(-len(mel) // WINDOW)}x{WINDOW};segments={len(loud)};loud={sum(b - a for a, b in loud)};mean={mel.mean():.1f};crc={zlib.crc32(stored):08x}"
            found = [len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha256(media).hexdigest(), feature]
            if full:
                found += [media, stored, [{"start_s": a * HOP / slow, "end_s": ((b - 1) * HOP + FRAME) / slow} for a, b in loud]]
            for n, v in zip(names, found):
                rows[n].append(v)
        return {"id": batch.column("id")} | rows

    schema = f"id {dict(docs.dtypes)[id_col]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    if full:
        schema += ", media binary, tensors binary, spans array<struct<start_s:double,end_s:double>>"
    return common.map_texts(docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text"), per_slice, schema).withColumnRenamed("id", id_col)


def op1_audio_features(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, the tensors with their time spans, and the spans of loud segments."""
    return audio_features(common.documents(spark, sf_dir)).drop("media")
