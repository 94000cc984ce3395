"""Embedders: a seam for models, and a deterministic hashing embedder that needs none."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelIdentity:
    name: str
    dim: int
    version: str


class Embedder(ABC):
    @property
    @abstractmethod
    def identity(self) -> ModelIdentity: ...

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """float32, a row for each text."""

    @abstractmethod
    def count_tokens(self, text: str) -> int: ...

    def column(self, text: Column) -> Column:
        """The embedding of a text column, by Arrow batches."""
        own = self

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(list(own.embed([t or "" for t in s])))

        return run(text)


class HashingEmbedder(Embedder):
    """Bag of words hashed into ``dim`` buckets."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    @property
    def identity(self) -> ModelIdentity:
        return ModelIdentity("hashing-bag", self.dim, "1")

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall("[a-z]+", t.lower()):
                out[i, int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % self.dim] += 1
        return out

    def count_tokens(self, text: str) -> int:
        return len(text.split())


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class OnnxEmbedder(Embedder):
    """A sentence model from local files: model.onnx and tokenizer.json in a folder. Gated: needs onnxruntime and tokenizers.

    A text of more than ``window`` tokens is embedded in windows, whose vectors are added up by their numbers of tokens: no tail is lost.
    """

    def __init__(self, folder: str, name: str, version: str = "1", batch: int = 32, window: int = 512):
        self.folder, self.name, self.version, self.batch, self.window, self._loaded = folder, name, version, batch, window, None

    def __getstate__(self):
        return {**self.__dict__, "_loaded": None}  # a worker loads its own

    def _load(self):
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            ruler = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            ruler.no_truncation()
            self._loaded = onnxruntime.InferenceSession(f"{self.folder}/model.onnx"), ruler
        return self._loaded

    @property
    def identity(self) -> ModelIdentity:
        session, _ = self._load()
        return ModelIdentity(self.name, int(session.get_outputs()[0].shape[-1]), self.version)

    def embed(self, texts: list[str]) -> np.ndarray:
        session, ruler = self._load()
        wanted, rows = {i.name for i in session.get_inputs()}, []
        parts, owner = [], []
        for k, e in enumerate(ruler.encode_batch(texts)):
            windows = [e.ids[at : at + self.window] for at in range(0, len(e.ids), self.window)] or [[]]
            parts += windows
            owner += [k] * len(windows)
        for lo in range(0, len(parts), self.batch):
            coded = parts[lo : lo + self.batch]
            width = max(1, *map(len, coded))
            ids = np.array([c + [0] * (width - len(c)) for c in coded], np.int64)
            mask = np.array([[1] * len(c) + [0] * (width - len(c)) for c in coded], np.int64)
            feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            first = session.run(None, {k: v for k, v in feeds.items() if k in wanted})[0][:, 0]
            rows.append(_unit(first) * np.array([[max(1, len(c))] for c in coded]))
        out = np.zeros((len(texts), rows[0].shape[1] if rows else self.identity.dim))
        if rows:
            np.add.at(out, owner, np.concatenate(rows))
        return _unit(out).astype(np.float32)

    def count_tokens(self, text: str) -> int:
        return len(self._load()[1].encode(text).ids)
