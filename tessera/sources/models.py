"""What a model looks like to the operators: an identity, a check before use, and functions of columns. No model is called over a network here."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval


class ModelUnavailable(RuntimeError):
    """Raised before any row is computed."""


def is_loopback(url: str) -> bool:
    """Whether a model's address is this machine."""
    host = re.match(r"[a-z]+://(\[[^\]]*\]|[^/:?#]*)", url)
    return bool(host) and (host[1].lower() in ("localhost", "[::1]") or bool(re.fullmatch(r"127\.\d{1,3}\.\d{1,3}\.\d{1,3}", host[1])))


@dataclass(frozen=True)
class Embedder:
    """embed: DataFrame (id, text) -> DataFrame (id, vec); available: asked once before a run."""

    provider_id: str
    embed: Callable[[DataFrame], DataFrame]
    available: Callable[[], bool] = lambda: True

    def __call__(self, texts: DataFrame) -> DataFrame:
        if not self.available():
            raise ModelUnavailable(self.provider_id)
        return self.embed(texts)


@dataclass(frozen=True)
class Summarizer:
    """summarize: column of prompts -> column of answers, null where one fails; a failure of one row fails no other."""

    provider_id: str
    summarize: Callable[[Column], Column]
    available: Callable[[], bool] = lambda: True

    def __call__(self, prompt: Column) -> Column:
        if not self.available():
            raise ModelUnavailable(self.provider_id)
        return self.summarize(prompt)


def hashing_embedder() -> Embedder:
    """The model-free embedder."""
    return Embedder("hashing-128", retrieval.hash_embed)


def first_words(n: int = 12) -> Summarizer:
    """A stand-in that answers with the first words of a prompt, and with null for an empty one."""
    return Summarizer(f"first-{n}-words", lambda p: F.nullif(F.array_join(F.slice(F.split(F.trim(p), r"\s+"), 1, n), " "), F.lit("")))
