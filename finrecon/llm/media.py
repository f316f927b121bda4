"""Audio columns: lossless 8-bit samples, log-mel features and energy segments.

``stored`` writes a payload as a mono 8-bit wave file, ``samples_of`` reads it back. ``resampled`` changes the rate by a rational factor with a
polyphase filter, so that no sample is computed that is not kept. ``log_mel`` takes overlapped windowed frames to mel bands. ``segments`` marks the frames whose
energy passes an upper limit and goes on until it falls below a lower one (hysteresis). ``media_columns`` stores the features as fixed-shape Arrow tensors of
``BLOCK`` frames, each with its time span. Every text is computed alone, so equal texts give equal bits.

Ids are integers. Defined cases: a null or empty text is one block of zeros; the last block of a tensor is filled with the floor value; long texts give more
blocks; repeated rows give a row each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from finrecon.llm.frames import in_arrow, own

RATE, UP, DOWN = 8000, 3, 4
FRAME, HOP, BANDS, BLOCK = 256, 128, 20, 64
UNIT = 64
HIGH_DB, LOW_DB = 3.0, 1.0
FLOOR = 1e-6
OUT_BYTES = 1 << 20


def payload_of(text: str | None) -> bytes:
    """The text as UTF-8, with zero bytes up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def stored(payload: bytes, rate: int = RATE) -> bytes:
    """A wave file of one channel of 8-bit samples."""
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def samples_of(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a wave file of one channel of 8-bit samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, rate = 12, 0
    while at < len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _low_pass(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Windowed sinc at the lower of the two rates, gain up."""
    n = np.arange(-taps * max(up, down), taps * max(up, down) + 1)
    return up / max(up, down) * np.sinc(n / max(up, down)) * np.hamming(len(n))


_FILTER = _low_pass(UP, DOWN)


def _phases(up: int, down: int, h: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each phase of the output the first input place of its window and the filter's taps over the window."""
    half = len(h) // 2
    reach = half // up + 1
    out = []
    for r in range(up):
        place, phase = divmod(r * down, up)
        tap = phase - np.arange(-reach, reach + 1) * up + half
        out.append((place, np.where((tap >= 0) & (tap < len(h)), h[np.clip(tap, 0, len(h) - 1)], 0.0)))
    return out


_PHASES = _phases(UP, DOWN, _FILTER)


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN, h: np.ndarray = _FILTER) -> np.ndarray:
    """x at up/down times its rate; output n is the filter's phase n * down mod up applied around input n * down / up."""
    phases = _PHASES if h is _FILTER and (up, down) == (UP, DOWN) else _phases(up, down, h)
    count, reach = -(-len(x) * up // down), len(h) // 2 // up + 1
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + down)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    out = np.empty(count)
    for r, (place, weight) in enumerate(phases[:count]):
        of = len(out[r::up])
        out[r::up] = windows[place : place + down * of : down][:of] @ weight
    return out


def mel_bank(rate: float, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, bins x bands."""
    edges = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    hz = 700 * (10 ** (edges / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    low, mid, high = hz[:-2], hz[1:-1], hz[2:]
    return np.maximum(0, np.minimum((bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)))


_BANK, _WINDOW = mel_bank(RATE * UP / DOWN), np.hanning(FRAME)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log band energies (frames x bands) and frame energies in dB, BLOCK frames at a time; the end is filled up to a whole frame."""
    frames = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    padded = np.concatenate([y, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(y)))])
    cut = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:frames]
    mel, level = np.empty((frames, BANDS), np.float32), np.empty(frames)
    for k in range(0, frames, BLOCK):
        power = np.abs(np.fft.rfft(cut[k : k + BLOCK] * _WINDOW, axis=1)) ** 2
        mel[k : k + BLOCK] = np.log(power @ _BANK + FLOOR)
        level[k : k + BLOCK] = 10 * np.log10(power.mean(axis=1) + FLOOR)
    return mel, level


def segments(level: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Runs of frames [start, stop) that reach the median level plus high and stay above the median plus low."""
    middle = np.median(level)
    mark = np.where(level >= middle + high, 1, np.where(level < middle + low, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features_of(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    y = resampled((np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128)
    mel, level = log_mel(y)
    return mel, segments(level)


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / (RATE * UP)


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream with a fixed-shape tensor of BLOCK frames per row and its time span."""
    blocks = -(-len(mel) // BLOCK)
    filled = np.full((blocks * BLOCK, BANDS), np.float32(np.log(FLOOR)))
    filled[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(blocks, BLOCK, BANDS))
    start = [seconds(k * BLOCK) for k in range(blocks)]
    end = [seconds(min((k + 1) * BLOCK, len(mel))) for k in range(blocks)]
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), column], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def bands_of(stream: bytes) -> np.ndarray:
    """The frames x bands that ``tensors`` stored, without the filling of the last block."""
    table = pa.ipc.open_stream(stream).read_all()
    blocks = table["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, BANDS)
    return blocks[: round(table["end_s"][-1].as_py() / seconds(1))]


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are given on together until they hold OUT_BYTES."""
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def together(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        media, mel, found, size = (list(c) for c in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary()), pa.array(mel, pa.binary()), pa.array(found, span), pa.array(size, pa.int64())], ["doc_id", "media", "log_mel", "segments", "n_bytes"])

    for batch in batches:
        rows, first, held = [], 0, 0
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            media = stored(payload_of(text))
            mel, runs = features_of(samples_of(media)[1])
            rows.append((media, tensors(mel), [{"start_s": seconds(a), "end_s": seconds(b)} for a, b in runs], len((text or "").encode("utf-8", "surrogatepass"))))
            held += len(rows[-1][0]) + len(rows[-1][1])
            if held >= OUT_BYTES:
                yield together(batch.column(0).slice(first, len(rows)), rows)
                rows, first, held = [], i + 1, 0
        if rows:
            yield together(batch.column(0).slice(first, len(rows)), rows)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media (wave file), log_mel (Arrow stream of fixed-shape tensors), segments (time spans), n_bytes (of the text)."""
    return in_arrow(own(docs, id_col, text_col), _columns, "doc_id long, media binary, log_mel binary, segments array<struct<start_s:double,end_s:double>>, n_bytes long")
