"""Embedding of texts and files: pluggable embedders run in Arrow batches, loaded once a worker."""

from __future__ import annotations

import hashlib
import io
import re
import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases a query is wrapped in before its vectors are averaged.
WRAPPERS = {
    "audio": ["the sound of {text}", "a recording of {text}", "{text}", "audio of {text}", "the noise of {text}"],
    "image": ["a photo of {text}", "a photograph of {text}", "an image of {text}", "{text}", "a picture of {text}"],
    "paragraph": ["a document about {text}", "an article discussing {text}", "{text}", "a text passage about {text}", "writing on the topic of {text}"],
    "video": ["a video of {text}", "a clip showing {text}", "{text}", "footage of {text}", "a video clip of {text}"],
}


class Embedder(Protocol):
    """Turns media bytes or texts into vectors of one length; None where it can't."""

    dim: int

    def embed_media(self, content: bytes) -> np.ndarray | None: ...

    def embed_text(self, text: str) -> np.ndarray | None: ...


class HashingEmbedder:
    """A deterministic bag-of-words embedder that needs no model files: signed hashes of words, normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed_text(self, text: str) -> np.ndarray | None:
        words = re.findall(r"\w+", text.lower())
        if not words:
            return None
        v = np.zeros(self.dim)
        for w in words:
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return v / n if n else None

    def embed_media(self, content: bytes) -> np.ndarray | None:
        return self.embed_text(content.decode("utf-8", "replace"))


class SoundEmbedder:
    """Vectors of WAV sounds without model files: log-mel frames of a short-time Fourier transform, pooled over time.

    Mean and spread of ``mels`` bands, centred and normalised; any rate, 8, 16 or 32 bits, channels averaged.  What is no
    WAV, and silence, gives None."""

    def __init__(self, mels: int = 32, window: int = 1024, hop: int = 512, low: float = 50.0, high: float = 8000.0):
        self.mels, self.window, self.hop, self.low, self.high, self.dim = mels, window, hop, low, high, 2 * mels
        self._banks: dict[int, np.ndarray] = {}

    def _bank(self, rate: int) -> np.ndarray:
        """Triangular bands, evenly spaced in mel, over the bins of the transform."""
        if rate not in self._banks:
            mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
            edges = 700 * (10 ** (np.linspace(mel(self.low), mel(min(self.high, rate / 2)), self.mels + 2) / 2595) - 1)
            at = np.fft.rfftfreq(self.window, 1 / rate)
            lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
            self._banks[rate] = np.maximum(0, np.minimum((at - lo) / (mid - lo), (hi - at) / (hi - mid)))
        return self._banks[rate]

    def spectrum(self, x: np.ndarray) -> np.ndarray:
        """Power of each window (rows) by frequency, under a Hann window; a short sound is padded to one."""
        x = np.pad(x, (0, max(0, self.window - len(x))))
        frames = np.lib.stride_tricks.sliding_window_view(x, self.window)[:: self.hop]
        return np.abs(np.fft.rfft(frames * np.hanning(self.window), axis=1)) ** 2

    def embed_media(self, content: bytes) -> np.ndarray | None:
        try:
            with wave.open(io.BytesIO(content)) as w:
                rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
        except (wave.Error, EOFError):
            return None
        if width not in (1, 2, 4) or not raw:
            return None
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
        x = (x - 128) / 128 if width == 1 else x / (1 << (8 * width - 1))
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
        if not x.any():
            return None
        power = self.spectrum(x) @ self._bank(rate).T
        bands = np.log(power + max(1e-4 * power.max(), 1e-12))  # 40 dB below the loudest band counts as silence
        v = np.concatenate([bands.mean(axis=0), bands.std(axis=0)])
        v[: self.mels] -= v[: self.mels].mean()
        n = np.linalg.norm(v)
        return v / n if n else None

    def embed_text(self, text: str) -> np.ndarray | None:
        return None


class PlanesEmbedder:
    """Vectors of raw pixels (height x width x 3 bytes, flattened): gradient directions in a grid of cells, and mean colours."""

    def __init__(self, height: int = 32, width: int = 32, cells: int = 4, directions: int = 8):
        self.height, self.width, self.cells, self.directions = height, width, cells, directions
        self.dim = cells * cells * (directions + 3)

    def embed_media(self, content: bytes) -> np.ndarray | None:
        if len(content) != self.height * self.width * 3:
            return None
        x = np.frombuffer(content, np.uint8).reshape(self.height, self.width, 3) / 255.0
        down, right = np.gradient(x.mean(axis=2))
        size, angle = np.hypot(down, right), np.arctan2(down, right) % (2 * np.pi)
        way = np.minimum((angle / (2 * np.pi) * self.directions).astype(int), self.directions - 1)
        row, col = (np.arange(n) * self.cells // n for n in (self.height, self.width))
        cell = row[:, None] * self.cells + col[None, :]
        hist = np.bincount((cell * self.directions + way).ravel(), size.ravel(), self.cells**2 * self.directions)
        area = np.bincount(cell.ravel(), minlength=self.cells**2)
        colours = np.stack([np.bincount(cell.ravel(), x[:, :, c].ravel(), self.cells**2) / area for c in range(3)], axis=1) - 0.5
        v = np.concatenate([hist / max(np.linalg.norm(hist), 1e-9), colours.ravel()])
        n = np.linalg.norm(v)
        return v / n if n else None

    def embed_text(self, text: str) -> np.ndarray | None:
        return None


def embed_query(embedder: Embedder, text: str, media_type: str = "paragraph", enrich: bool = False) -> np.ndarray:
    """Vector of a query text; enriched, the normalised mean over the type's wrappers, those that fail left out."""
    if not text or not text.strip():
        raise ValueError("the query is empty")
    if enrich:
        found = [v for w in WRAPPERS.get(media_type, []) if (v := embedder.embed_text(w.format(text=text))) is not None]
        if found:
            mean = np.mean(found, axis=0)
            n = np.linalg.norm(mean)
            return mean / n if n else mean
    v = embedder.embed_text(text)
    if v is None:
        raise ValueError("the query can't be embedded")
    return v


def embedded(df: DataFrame, make: Callable[[], Embedder], column: str, out: str = "embedding") -> DataFrame:
    """``df`` with vectors of a text or binary column; ``make`` is called once a worker task."""
    binary = df.schema[column].dataType.typeName() == "binary"

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        one = own.embed_media if binary else own.embed_text
        for s in batches:
            found = [None if x is None else one(bytes(x) if binary else x) for x in s]
            yield pd.Series([None if v is None else np.asarray(v, np.float32) for v in found], dtype=object)

    # said to be nondeterministic so that a filter on the vector does not run it a second time
    return df.withColumn(out, vectors.asNondeterministic()(F.col(column)))
