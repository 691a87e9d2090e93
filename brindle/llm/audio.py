"""Audio features: polyphase resampling, overlapped log-mel filterbanks, hysteresis segments.

Media are mono 8-bit PCM in WAV containers. Features are fixed-shape tensors of ``TENSOR_FRAMES``
by ``MELS`` log energies with the time span of each, stored as an Arrow IPC stream of a
``fixed_shape_tensor`` column beside the segments; the ``feature`` text is derived from what was
stored. Work on samples goes over blocks of frames; a recording's tensors, about a third of its
bytes, are held whole.

A null text is stored as the empty text; every payload is padded with zero bytes to a positive
multiple of 64. Equal payloads give equal media and features; repeated rows are each computed;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import crc32, text_bytes, written

RATE = 16_000
#: Resampling ratio and taps of each phase.
UP, DOWN, TAPS = 3, 4, 24
#: Bytes of tensors handed on at once (speed and memory only).
BATCH_BYTES = 16 << 20
#: Frame and hop in resampled samples, mel bands, frames of a tensor, frames worked on at once.
FRAME, HOP, MELS, TENSOR_FRAMES, BLOCK = 384, 192, 20, 64, 2048


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono unsigned 8-bit PCM in a RIFF container."""
    pad = b"\0" * (len(payload) % 2)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(payload) + len(pad)) + b"WAVE" + head + payload + pad


def samples(media: bytes) -> tuple[bytes, int]:
    """The 8-bit samples and the rate that a WAV container holds."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, rate = 12, RATE
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 if data else 64)


def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass split into ``up`` phases of ``taps`` taps."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hamming(n) * up
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1].astype(np.float32))


def _mel_bank(rate: float, bands: int, frame: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(40.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    rise = (f[None, :] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    fall = (points[2:, None] - f[None, :]) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


PHASES = _phases(UP, DOWN, TAPS)
BANK = _mel_bank(RATE * UP / DOWN, MELS, FRAME)
HANN = np.hanning(FRAME).astype(np.float32)


def resample(pcm: np.ndarray, start: int, stop: int, up: int = UP, down: int = DOWN, phases: np.ndarray = PHASES) -> np.ndarray:
    """Output samples ``start`` to ``stop`` of the polyphase resampler; silence lies outside the input."""
    taps = phases.shape[1]
    first, last = start * down // up - taps // 2, (stop - 1) * down // up + taps
    x = np.zeros(last - first, np.float32)
    a, b = max(first, 0), min(last, len(pcm))
    if b > a:
        x[a - first : b - first] = pcm[a:b].astype(np.float32) / 128 - 1
    view = np.lib.stride_tricks.sliding_window_view(x, taps)
    out = np.empty(stop - start, np.float32)
    for r in range(min(up, stop - start)):
        n = np.arange(start + r, stop, up)
        base = n * down // up - taps // 2 - first
        out[r::up] = view[base[0] : base[-1] + 1 : down] @ phases[(start + r) * down % up]
    return out


def frame_count(n_samples: int) -> int:
    n = -(-n_samples * UP // DOWN)
    return max(1, 1 + -(-(n - FRAME) // HOP))


def log_mel(pcm: np.ndarray):
    """Blocks of (log-mel energies, log energy) of overlapped frames, in order."""
    total = frame_count(len(pcm))
    for f in range(0, total, BLOCK):
        n = min(BLOCK, total - f)
        y = resample(pcm, f * HOP, (f + n - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * HANN, axis=1)).astype(np.float32) ** 2
        yield np.log10(power @ BANK + 1e-6), np.log10((frames**2).mean(1) + 1e-6)


def segments(energy: np.ndarray, high: float = 0.6, low: float = 0.4) -> list[tuple[int, int]]:
    """Frame runs above the low threshold that reach the high one; thresholds as shares of the energy range."""
    least, most = float(energy.min()), float(energy.max())
    if most - least < 1e-6:
        return []
    active = energy >= least + low * (most - least)
    peak = energy >= least + high * (most - least)
    step = np.diff(np.concatenate(([0], active.view(np.int8), [0])))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    seen = np.concatenate(([0], np.cumsum(peak)))
    keep = seen[stops] > seen[starts]
    return list(zip(starts[keep].tolist(), stops[keep].tolist()))


def _ms(frame: int) -> int:
    return frame * HOP * DOWN * 1000 // (UP * RATE)


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream: fixed-shape tensors of the frames (the last padded) and their time spans."""
    count = -(-len(mel) // TENSOR_FRAMES)
    full = np.zeros((count * TENSOR_FRAMES, MELS), np.float32)
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TENSOR_FRAMES * MELS)
    spans = [(_ms(i * TENSOR_FRAMES), _ms(min(len(mel), (i + 1) * TENSOR_FRAMES))) for i in range(count)]
    batch = pa.RecordBatch.from_arrays(
        [pa.ExtensionArray.from_storage(kind, storage), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())],
        names=["log_mel", "start_ms", "end_ms"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def analyse(pcm: np.ndarray) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The tensors of one recording, its number of frames and all its segments."""
    mels, energies = zip(*log_mel(pcm))
    energy = np.concatenate(energies)
    return tensors(np.concatenate(mels)), len(energy), segments(energy)


def stored_mel(stream: bytes, frames: int) -> np.ndarray:
    """The log-mel energies that an Arrow IPC stream of ``tensors`` holds, without the padding."""
    column = pa.ipc.open_stream(stream).read_all()["log_mel"]
    return np.concatenate([c.storage.flatten().to_numpy() for c in column.chunks]).reshape(-1, MELS)[:frames]


def describe(stream: bytes, frames: int, found: list[tuple[int, int]]) -> str:
    """A digest of the stored features of one recording, with the time spans of all its segments."""
    mel = stored_mel(stream, frames)
    total, digest = np.zeros(MELS), hashlib.sha256()
    for f in range(0, frames, BLOCK):
        part = mel[f : f + BLOCK]
        digest.update(np.rint(part * 16).astype("<i2").tobytes())
        total += part.sum(0, dtype=np.float64)
    mean = ",".join(f"{v:.2f}" for v in total / frames)
    voiced = ",".join(f"{_ms(a)}-{_ms(b)}" for a, b in found)
    return f"frames={frames};mels={MELS};segments={len(found)};active={sum(b - a for a, b in found)};spans={voiced};mean={mean};sha={digest.hexdigest()[:16]}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (WAV) of every text."""

    def rows(batches):
        for b in batches:
            data = text_bytes(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([wav(padded(d)) for d in data], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_bytes long, media binary")


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def audio_tensors(media: DataFrame) -> DataFrame:
    """For each row of ``media`` (doc_id, n_bytes, media): digests of payload and media, the number
    of frames, the first and last (exclusive) frame of every segment, the feature tensors."""
    fields = STORED + ", frames long, starts array<long>, stops array<long>, tensors binary"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=names)

    def rows(batches):
        for b in batches:
            out, held = [], 0
            for doc_id, n, stored in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media")):
                stored = stored.as_py()
                payload, _ = samples(stored)
                kept, frames, found = analyse(np.frombuffer(payload, np.uint8))
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), frames, [a for a, _ in found], [z for _, z in found], kept))
                held += len(kept)
                if held >= BATCH_BYTES:
                    yield batch(out)
                    out, held = [], 0
            yield batch(out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, fields)


def audio_features(stored: DataFrame, keep_tensors: bool = False) -> DataFrame:
    """For each row of ``stored`` (of ``audio_tensors``): digests of payload and media, the features'
    digest and, if asked for, the feature tensors as an Arrow IPC stream."""
    fields = STORED + ", feature string" + ", tensors binary" * keep_tensors
    names = [f.split()[0] for f in fields.split(", ")]
    given = [f.split()[0] for f in STORED.split(", ")]

    def rows(batches):
        for b in batches:
            of = zip(b.column("tensors"), b.column("frames").to_pylist(), b.column("starts").to_pylist(), b.column("stops").to_pylist())
            feature = pa.array([describe(t.as_py(), n, list(zip(a, z))) for t, n, a, z in of], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in given), feature, *([b.column("tensors")] * keep_tensors)], names=names)

    return stored.mapInArrow(rows, fields)


def store_and_describe(docs: DataFrame, keep_tensors: bool = False) -> DataFrame:
    """Store every text as audio in the shared folder, read the stored bytes back, store their tensors and describe these."""
    return audio_features(written(audio_tensors(written(encode_media(docs), "media")), "tensors"), keep_tensors)
