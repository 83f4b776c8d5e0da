"""Vector columns and the default embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where a vector is; within [-1, 1]."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.least(dot(a, b) / n, F.lit(1.0)), F.lit(-1.0))).when(n.isNotNull(), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def token_hash(token: str) -> int:
    """``h = 33 h + byte`` from 5381, modulo 2**64."""
    h = 5381
    for b in token.encode("utf-8"):
        h = (h * 33 + b) & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Deterministic embedder: counts of hashed white-space tokens, scaled to unit length. Empty text gives zeros, null null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            v = np.zeros(dim, np.float64)
            for w in t.split():
                k = known.get(w)
                if k is None:
                    k = known[w] = token_hash(w) % dim
                v[k] += 1
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return run(text)


def token_ids(text: Column, vocabulary: int = 30521) -> Column:
    """Pseudo token ids ``hash % vocabulary + 1`` of white-space words."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [token_hash(w) % vocabulary + 1 for w in t.split()])

    return run(text)


def truncated(text: Column, most: int = 256) -> Column:
    """The text before its ``most``-th character of Unicode white space."""
    return F.regexp_extract(text, rf"^(?sU)((?:\S*+\s){{0,{most - 1}}}+\S*+)", 1)


def mean_pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors ``[n, length, dim]`` that the mask ``[n, length]`` keeps."""
    m = mask[:, :, None].astype(np.float32)
    return (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def onnx_embedding(text: Column, model: str, tokenizer: str, dim: int = 384, batch: int = 32) -> Column:
    """Sentence vectors of an ONNX model with its tokenizer file, mean-pooled and scaled; loaded once per task."""
    from collections.abc import Iterator

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime as ort
        from tokenizers import Tokenizer

        session, tok = ort.InferenceSession(model), Tokenizer.from_file(tokenizer)
        tok.enable_padding()
        tok.enable_truncation(256)
        names = {i.name for i in session.get_inputs()}
        for texts in parts:
            out = []
            for a in range(0, len(texts), batch):
                enc = tok.encode_batch([t or "" for t in texts.iloc[a : a + batch]])
                ids, mask = np.array([e.ids for e in enc], np.int64), np.array([e.attention_mask for e in enc], np.int64)
                feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                v = mean_pooled(session.run(None, {k: x for k, x in feed.items() if k in names})[0], mask)
                out += list((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32))
            yield pd.Series(out)

    return run(text)
