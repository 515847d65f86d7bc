"""Deterministic stand-ins for the models a user supplies.

They make tests and examples run without a network.  Each is a pure function of
its input, as real models given to this library must be.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np

LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"\w+")
_CHUNK = re.compile(r"CHUNK ID: (.*?)\nTEXT: (.*?)\n\n", re.DOTALL)
_QUESTION = re.compile(r'Question: "(.*)"\nReply: \Z', re.DOTALL)


class HashingEmbedder:
    """Bag of words, each word hashed to a signed coordinate."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in _WORD.findall((text or "").lower()):
                code = zlib.crc32(word.encode())
                out[row, code % self.dim] += 1.0 if (code >> 16) & 1 else -1.0
        return out


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each of a-z occurs: an embedding that SQL can compute as well."""
    return np.array([[(t or "").count(c) for c in LETTERS] for t in texts], dtype=np.float32).reshape(-1, 26)


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """The share of the question's words that the chunk has."""
    scores = []
    for question, chunk in pairs:
        asked = set(_WORD.findall(question.lower()))
        scores.append(len(asked & set(_WORD.findall(chunk.lower()))) / max(1, len(asked)))
    return scores


def rule_model(prompts: list[str]) -> list[str]:
    """Replies by rule: routes counting questions to SQL, quotes the first chunk it is shown."""
    return [_reply(p) for p in prompts]


def _reply(prompt: str) -> str:
    found = _QUESTION.search(prompt)
    question = found.group(1) if found else ""
    if '"route"' in prompt:
        return json.dumps({"route": "SQL" if "how many" in question.lower() else "SEMANTIC"})
    if '"query"' in prompt:
        if question.startswith("Delete"):
            return json.dumps({"query": "DELETE FROM kna1"})
        place = re.search(r" in (\w+)\?", question)
        where = f" WHERE land1 = '{place[1]}'" if place else ""
        return json.dumps({"query": f"SELECT count(*) AS n FROM kna1{where}"})
    if '"filters"' in prompt:
        excluded = re.findall(r"\bnot in (\w+)", question)
        return json.dumps({"intent": question, "filters": [f"NOT {x}" for x in excluded]})
    chunk = _CHUNK.search(prompt)
    reply = {"answer_found": bool(chunk), "answer": "", "exact_quote": "", "source_chunk_id": ""}
    if chunk:
        reply |= {"answer": chunk[2], "exact_quote": chunk[2], "source_chunk_id": chunk[1]}
    return "```json\n" + json.dumps(reply) + "\n```"
