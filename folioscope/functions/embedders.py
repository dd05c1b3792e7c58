"""Embedders by name: whatever makes vectors of texts can be registered; none makes up a vector it does not have."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Name -> function of a folder or None that gives a function from texts to a matrix; it is called once per task.
_KNOWN: dict[str, Callable[[str | None], Callable[[list[str]], np.ndarray]]] = {}


def register(name: str, make: Callable[[str | None], Callable[[list[str]], np.ndarray]]) -> None:
    _KNOWN[name] = make


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the token vectors that the mask keeps, of length 1."""
    m = mask[:, :, None].astype(hidden.dtype)
    v = (hidden * m).sum(1) / np.maximum(m.sum(1), 1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def onnx(folder: str | None) -> Callable[[list[str]], np.ndarray]:
    """The model of a folder (model.onnx and tokenizer.json); an error where either is missing, never a vector of zeros."""
    import os

    import onnxruntime
    from tokenizers import Tokenizer

    model, words = os.path.join(folder or "", "model.onnx"), os.path.join(folder or "", "tokenizer.json")
    for f in (model, words):
        if not os.path.isfile(f):
            raise FileNotFoundError(f"the embedder needs {f}")
    session, tokenizer = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]), Tokenizer.from_file(words)
    tokenizer.enable_padding()
    names = {i.name for i in session.get_inputs()}

    def embed(texts: list[str]) -> np.ndarray:
        enc = tokenizer.encode_batch(texts)
        given = {"input_ids": np.array([e.ids for e in enc]), "attention_mask": np.array([e.attention_mask for e in enc]), "token_type_ids": np.array([e.type_ids for e in enc])}
        return mean_pooled(session.run(None, {k: v for k, v in given.items() if k in names})[0], given["attention_mask"])

    return embed


register("onnx", onnx)


def embedded(df: DataFrame, key: str, text: str, name: str, folder: str | None = None, size: int = 16) -> DataFrame:
    """key, v of every text by a registered embedder, `size` texts at once; null texts have a null vector."""
    make = _KNOWN[name]

    def run(batches: Iterable[pa.RecordBatch]):
        embed = None
        for b in batches:
            embed = embed or make(folder)
            texts = b.column(1).to_pylist()
            at = [k for k, t in enumerate(texts) if t is not None]
            out: list[np.ndarray | None] = [None] * len(texts)
            for lo in range(0, len(at), size):
                for k, v in zip(at[lo : lo + size], embed([texts[k] for k in at[lo : lo + size]])):
                    out[k] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["key", "v"])

    return df.select(key, text).mapInArrow(run, f"key {dict(df.dtypes)[key]}, v array<double>").withColumnRenamed("key", key)
