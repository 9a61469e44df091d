"""Models that the engine calls, as protocols, with stand-ins that need no network. What is plugged
in must be picklable: it runs in Python workers, where it may keep its model in a global."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompt: str, history: list[tuple[str, str]]) -> str | None: ...


class HashEmbedder:
    """A unit vector of the hashes of a text's words."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1 if h >> 63 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out


class OverlapReranker:
    """The share of the query's words that a text has."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


class SameOrder:
    """Leaves rows as they are."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        return [-float(i) for i in range(len(texts))]


class FirstPassage:
    """Answers with the first passage of the prompt."""

    def generate(self, prompt: str, history: list[tuple[str, str]]) -> str | None:
        lines = [x for x in prompt.split("\n") if x.startswith("[1]")]
        return lines[0][4:].strip() if lines else "CLARIFICATION_NEEDED: What is this about?"


EMBEDDERS: dict[str, type] = {"hash": HashEmbedder}
RERANKERS: dict[str, type] = {"overlap": OverlapReranker, "none": SameOrder}
GENERATORS: dict[str, type] = {"first": FirstPassage}


def reranker(name: str | None) -> Reranker:
    """By name; an unknown one leaves rows as they are."""
    return RERANKERS.get((name or "none").lower(), SameOrder)()


def embedder(name: str, size: int) -> Embedder | None:
    made = EMBEDDERS.get(name.lower())
    return made(size) if made else None
