"""Loaders of embedding models for ``embed``; each imports its library in the task that uses it, and fails there without it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

# The models that are meant unless others are named
GGUF, NAMED = "models/Qwen3-Embedding-4B-Q8_0.gguf", "Qwen/Qwen3-Embedding-4B"


def gguf(model_path: str = GGUF, *, n_gpu_layers: int = -1, n_ctx: int = 8192, n_batch: int = 512, verbose: bool = False) -> Callable[[], Callable]:
    """A quantised model file, one text at a time; the last token's state stands for the text."""

    def load() -> Callable[[Sequence[str]], np.ndarray]:
        import llama_cpp

        model = llama_cpp.Llama(model_path=model_path, embedding=True, n_gpu_layers=n_gpu_layers, n_ctx=n_ctx, n_batch=n_batch, verbose=verbose, pooling_type=llama_cpp.LLAMA_POOLING_TYPE_LAST)
        return lambda texts: np.array([model.embed(t) for t in texts], np.float64)

    return load


def sentence_transformer(model_name: str = NAMED, *, device: str = "cuda", low_memory: bool = False, batch_size: int = 8) -> Callable[[], Callable]:
    """A model by name, in batches; in half precision if memory is low."""

    def load() -> Callable[[Sequence[str]], np.ndarray]:
        from sentence_transformers import SentenceTransformer

        options = {"model_kwargs": {"torch_dtype": "float16"}} if low_memory else {}
        model = SentenceTransformer(model_name, device=device, **options)
        return lambda texts: np.asarray(model.encode(list(texts), batch_size=batch_size, normalize_embeddings=False))

    return load
