"""Embedding models: where their files are and how texts become vectors.

An embedder is any picklable object with ``model_id``, ``embed(texts)`` returning a
float32 matrix with one row per text, and ``embed_query(text)`` returning one row.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import SparkSession

from ..config import BATCH_SIZE, MAX_TOKENS, QUERY_INSTRUCTION, Config
from ..session import runs_locally

MODEL_FILE = "model.onnx"
TOKENIZER_FILE = "tokenizer.json"


class Embedder(Protocol):
    model_id: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...

    def embed_query(self, query: str) -> np.ndarray: ...


def resolve_files(cfg: Config) -> tuple[str, str]:
    """Paths of the model and tokenizer: a local folder, else the model hub."""
    if cfg.model_dir:
        paths = tuple(os.path.join(cfg.model_dir, f) for f in (MODEL_FILE, TOKENIZER_FILE))
        for path in paths:
            if not os.path.isfile(path):
                raise FileNotFoundError(f"model folder lacks {path}")
        return paths
    owner, slash, name = cfg.model_repo.partition("/")
    if not (owner and slash and name):
        raise ValueError(f"{cfg.model_repo!r} is not an owner/name model reference")
    try:
        from huggingface_hub import hf_hub_download
    except ImportError as err:
        raise RuntimeError(
            f"fetching {cfg.model_repo} needs the huggingface_hub package; "
            "set model_dir to a folder with model.onnx and tokenizer.json instead"
        ) from err
    return (
        hf_hub_download(cfg.model_repo, f"onnx/{MODEL_FILE}"),
        hf_hub_download(cfg.model_repo, TOKENIZER_FILE),
    )


class OnnxEmbedder:
    """Sentence vectors from an ONNX encoder: first token's state, unit length.

    Only file names travel with the closure; each Python worker opens its own
    single-threaded session on first use, as Spark already runs one task per core.
    """

    def __init__(self, model_path: str, tokenizer_path: str, model_id: str) -> None:
        self.model_id = model_id
        self._paths = {MODEL_FILE: model_path, TOKENIZER_FILE: tokenizer_path}
        self._shipped: dict[str, str] = {}
        self._loaded = None

    @classmethod
    def load(cls, spark: SparkSession, cfg: Config) -> OnnxEmbedder:
        model, tokenizer = resolve_files(cfg)
        embedder = cls(model, tokenizer, cfg.model_dir or cfg.model_repo)
        if not runs_locally(spark):
            for name, path in embedder._paths.items():
                spark.sparkContext.addFile(path)
                embedder._shipped[name] = os.path.basename(path)
        return embedder

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}

    def _locate(self, name: str) -> str:
        if name in self._shipped and not os.path.isfile(self._paths[name]):
            from pyspark import SparkFiles

            return SparkFiles.get(self._shipped[name])
        return self._paths[name]

    def _open(self):
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            session = onnxruntime.InferenceSession(
                self._locate(MODEL_FILE), options, providers=["CPUExecutionProvider"]
            )
            tokenizer = Tokenizer.from_file(self._locate(TOKENIZER_FILE))
            tokenizer.enable_truncation(MAX_TOKENS)
            tokenizer.enable_padding()
            self._loaded = session, tokenizer
        return self._loaded

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        slices = [texts[i : i + BATCH_SIZE] for i in range(0, len(texts), BATCH_SIZE)]
        return np.concatenate([self._embed_slice(s) for s in slices])

    def embed_query(self, query: str) -> np.ndarray:
        return self._embed_slice([QUERY_INSTRUCTION + query])[0]

    def _embed_slice(self, texts: Sequence[str]) -> np.ndarray:
        session, tokenizer = self._open()
        encoded = tokenizer.encode_batch(list(texts))
        inputs = {
            "input_ids": [e.ids for e in encoded],
            "attention_mask": [e.attention_mask for e in encoded],
            "token_type_ids": [e.type_ids for e in encoded],
        }
        feeds = {name: np.asarray(rows, dtype=np.int64) for name, rows in inputs.items()}
        output = session.get_outputs()[0].name
        hidden = session.run([output], feeds)[0]
        if hidden.ndim != 3:
            raise ValueError(f"the model's first output has shape {hidden.shape}, not three axes")
        first = hidden[:, 0, :].astype(np.float32)
        norms = np.linalg.norm(first, axis=1, keepdims=True)
        return np.divide(first, norms, out=first, where=norms > 0)
