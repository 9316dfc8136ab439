"""Counters of sub-word tokens for packing and limits, from a tokenizer's file."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=4)
def _library(path: str):
    """The tokenizer, loaded once a worker: .model files are piece models, others tokenizer definitions."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


class SubwordCounter:
    """Sub-words of a text, special tokens not counted. Only the path travels to the workers, which must all see the file."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, text: str) -> int:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[int]:
        """Counts of many texts; null and empty ones have none."""
        full = [t or "" for t in texts]
        if self.path.endswith(".model"):
            return [len(ids) for ids in _library(self.path).encode(full, num_threads=1)]
        return [len(e.ids) for e in _library(self.path).encode_batch_fast(full, add_special_tokens=False)]
