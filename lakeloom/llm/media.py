"""Media columns: 8-bit audio clips with log-mel features as fixed-shape Arrow tensors.

A clip is a mono WAV file. Its features come from polyphase resampling to a common rate,
overlapped log-mel filterbanks and a hysteresis segmentation of the frame energies.
"""

from __future__ import annotations

import io
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes before the samples in the WAV files written here.
WAV_HEADER = 44


def wav_bytes(payload: bytes, rate: int) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; a payload of odd size gets the pad byte that RIFF asks for."""
    pad = len(payload) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVE"
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + form + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def wav_samples(media: bytes) -> tuple[int, memoryview]:
    """Rate and stored bytes of the first ``data`` chunk of such a file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is supported")
        elif kind == b"data":
            return rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


class Resampler:
    """Polyphase rate conversion by ``up / down`` with a Kaiser-windowed sinc of ``half`` lobes a side."""

    def __init__(self, source: int, target: int, half: int = 8):
        g = math.gcd(source, target)
        self.up, self.down = target // g, source // g
        wide = half * max(self.up, self.down)
        n = np.arange(-wide, wide + 1)
        taps = np.sinc(n / max(self.up, self.down)) * np.kaiser(2 * wide + 1, 8.0)
        self.taps, self.wide = taps * (self.up / taps.sum()), wide

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Samples at the target rate; sample n is taken at time n * down / up of the input, zeros lie outside."""
        if self.up == self.down:
            return x.astype(np.float64)
        size = -(-len(x) * self.up // self.down)
        reach = self.wide // self.up + 2
        padded = np.concatenate((np.zeros(reach), x, np.zeros(reach + self.down)))
        out = np.zeros(size)
        for phase in range(min(self.up, size)):
            rows = -(-(size - phase) // self.up)
            at = phase * self.down
            first, rest = at // self.up, at % self.up
            # input index first - k pairs with tap rest + k * up, for every k inside the filter
            for k in range(-((self.wide + rest) // self.up), (self.wide - rest) // self.up + 1):
                start = reach + first - k
                out[phase :: self.up] += self.taps[self.wide + rest + k * self.up] * padded[start : start + (rows - 1) * self.down + 1 : self.down]
        return out


def mel_filters(rate: int, fft: int, bands: int) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale, as a matrix of ``fft // 2 + 1`` by ``bands``."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, fft // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray, window: int, hop: int, fft: int, filters: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows of overlapped frames and each frame's mean power; the last frame is padded with zeros."""
    frames = max(1, -(-max(len(x) - window, 0) // hop) + 1)
    x = np.concatenate((x, np.zeros((frames - 1) * hop + window - len(x)))) if (frames - 1) * hop + window > len(x) else x
    view, shape = np.lib.stride_tricks.sliding_window_view(x, window)[::hop], np.hanning(window)
    mels, power = np.empty((frames, filters.shape[1]), np.float32), np.empty(frames)
    for a in range(0, frames, block):
        part = view[a : a + block]
        mels[a : a + block] = np.log(np.abs(np.fft.rfft(part * shape, fft)) ** 2 @ filters + 1e-10)
        power[a : a + block] = (part * part).mean(axis=1)
    return mels, power


def hysteresis(power: np.ndarray, low: float, high: float) -> np.ndarray:
    """Runs of frames above ``low`` times the mean power that reach ``high`` times it; rows of first, end."""
    mean = power.mean() if len(power) else 0.0
    on = np.concatenate(([False], power > low * mean, [False]))
    edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    peaks = np.concatenate(([0], np.cumsum(power >= high * mean)))
    return edge[peaks[edge[:, 1]] > peaks[edge[:, 0]]] if len(edge) else edge


class Features:
    """Tensors and spans of one clip, as the bytes of an Arrow stream."""

    def __init__(self, source: int, rate: int, bands: int = 32, frames: int = 64, window: float = 0.025, hop: float = 0.01, low: float = 0.6, high: float = 1.2):
        self.rate, self.bands, self.frames, self.low, self.high = rate, bands, frames, low, high
        self.window, self.hop = round(window * rate), round(hop * rate)
        self.fft = 1 << (self.window - 1).bit_length()
        self.resample, self.filters = Resampler(source, rate), mel_filters(rate, self.fft, bands)
        self.schema = pa.schema(
            [("tensor", pa.fixed_shape_tensor(pa.float32(), [frames, bands])), ("start_s", pa.float64()), ("end_s", pa.float64()), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])))]
        )

    def __call__(self, samples: np.ndarray) -> tuple[int, int, bytes]:
        """Frames, segments and the stream: a row a tensor, with the segments that begin in its span."""
        mels, power = log_mel(self.resample((samples.astype(np.float64) - 128) / 128), self.window, self.hop, self.fft, self.filters)
        runs, rows = hysteresis(power, self.low, self.high), -(-len(mels) // self.frames)
        tensor = np.zeros((rows * self.frames, self.bands), np.float32)
        tensor[: len(mels)] = mels
        at = np.arange(rows) * self.frames
        end = np.minimum(at + self.frames, len(mels))
        first = np.searchsorted(runs[:, 0], np.append(at, len(mels))).astype(np.int32)
        step = self.hop / self.rate
        spans = pa.StructArray.from_arrays([pa.array(runs[:, 0] * step), pa.array((runs[:, 1] - 1) * step + self.window / self.rate)], ["start_s", "end_s"])
        kind = self.schema.field(0).type
        values = pa.FixedSizeListArray.from_arrays(pa.array(tensor.ravel()), self.frames * self.bands)
        columns = [pa.ExtensionArray.from_storage(kind, values), pa.array(at * step), pa.array((end - 1) * step + self.window / self.rate), pa.ListArray.from_arrays(pa.array(first), spans)]
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, self.schema, strict=True)], schema=self.schema))
        return len(mels), len(runs), sink.getvalue()


def read_features(stream: bytes) -> pa.Table:
    """The tensors, time spans and segments of one clip."""
    return pa.ipc.open_stream(stream).read_all()


def text_payload(text: str, multiple: int = 64) -> bytes:
    """The UTF-8 bytes of a text with zeros up to a positive multiple of ``multiple``."""
    data = text.encode()
    return data + b"\0" * (max(1, -(-len(data) // multiple)) * multiple - len(data))


def audio_clips(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_rate: int = 12_000, rate: int = 8_000, **options) -> DataFrame:
    """Store every whole text as an audio clip and compute the clip's features from the stored bytes.

    Returns a row a row of the input: ``doc_id, n_bytes, media binary`` (WAV), ``payload_at int``
    (where its samples start), ``payload_bytes, n_frames, n_segments, features binary`` (an Arrow
    stream for ``read_features``). A null text counts as empty, an empty one becomes 64 zero
    samples; texts of any length are stored whole; equal texts give equal bytes; repeated rows are
    kept; other columns are ignored. One clip is held in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(source_rate, rate, **options)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                media = wav_bytes(text_payload(text), source_rate)
                _, stored = wav_samples(media)
                n_frames, n_segments, stream = features(np.frombuffer(stored, np.uint8))
                rows.append((doc_id, len(text.encode()), media, WAV_HEADER, len(stored), n_frames, n_segments, stream))
                size += len(media) + len(stream)
                if size > 8_000_000:
                    yield rows_batch(rows)
                    rows, size = [], 0
            if rows:
                yield rows_batch(rows)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload_at int, payload_bytes long, n_frames int, n_segments int, features binary")


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "payload_at": pa.int32(), "payload_bytes": pa.int64(), "n_frames": pa.int32(), "n_segments": pa.int32(), "features": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def op1_audio_features(spark, sf_dir: str) -> DataFrame:
    """Digests of the stored clip, of the samples read back from it and of its features."""
    from .common import table

    clips = audio_clips(table(spark, sf_dir, "documents"))
    payload = F.expr("substring(media, payload_at + 1, payload_bytes)")
    return clips.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, payload_at + 1 + payload_bytes - 64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_frames"), F.col("n_segments"), F.sha2("features", 256)).alias("feature"),
    )
