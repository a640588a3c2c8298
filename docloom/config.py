"""Every knob of the engine, with the range it is held to."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "DOCLOOM_"
#: What a question is embedded with. Fixed value.
EMBED_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："

#: default, lowest, highest (None: no bound). Fixed values.
RANGES: dict[str, tuple[float, float | None, float | None]] = {
    "chunk_size": (300, 100, None),
    "chunk_overlap": (50, 0, None),
    "chunk_min_ratio": (0.3, 0.0, 1.0),
    "top_k_low": (2, 1, 10),
    "top_k_high": (5, 1, 20),
    "recall_cap": (50, 1, 100),
    "min_score": (0.15, 0.0, 1.0),
    "dedupe_similarity": (0.72, 0.4, 0.95),
    "rerank_pool": (8, 3, 30),
    "rerank_text_chars": (480, 120, 2000),
    "rerank_min_score": (0.0, 0.0, 1.0),
    "history_turns": (5, 4, 6),
    "chat_top_k": (4, 1, 10),
    "final_summary_chars": (500, 100, 1200),
    "final_facts_chars": (600, 100, 2000),
    "final_facts_top_k": (5, 1, 20),
    "final_summary_sentences": (3, 1, 10),
    "final_recent_messages": (4, 0, 10),
    "final_message_chars": (200, 50, 800),
    "final_doc_chars": (3200, 500, 8000),
    "final_chat_chars_with_doc": (800, 0, 4000),
    "final_chat_chars": (1500, 0, 4000),
    "summary_section_chars": (2500, 800, None),
    "summary_max_sections": (8, 1, 20),
    "agent_max_steps": (2, 1, 6),
    "max_pages": (120, 1, None),
}


def held(name: str, value) -> int | float:
    """The value as a number of the knob's kind in its range; the default if it is none."""
    default, low, high = RANGES[name]
    try:
        number = type(default)(value)
    except (TypeError, ValueError):
        number = default
    number = number if low is None else max(low, number)
    return number if high is None else min(high, number)


@dataclass(frozen=True)
class Config:
    chunk_size: int = 300
    chunk_overlap: int = 50
    chunk_min_ratio: float = 0.3
    chunk_strategy: str = "auto"
    top_k_low: int = 2
    top_k_high: int = 5
    recall_cap: int = 50
    min_score: float = 0.15
    dedupe_similarity: float = 0.72
    rerank_pool: int = 8
    rerank_text_chars: int = 480
    rerank_min_score: float = 0.0
    history_turns: int = 5
    chat_top_k: int = 4
    final_summary_chars: int = 500
    final_facts_chars: int = 600
    final_facts_top_k: int = 5
    final_summary_sentences: int = 3
    final_recent_messages: int = 4
    final_message_chars: int = 200
    final_doc_chars: int = 3200
    final_chat_chars_with_doc: int = 800
    final_chat_chars: int = 1500
    summary_section_chars: int = 2500
    summary_max_sections: int = 8
    agent_max_steps: int = 2
    max_pages: int = 120

    @classmethod
    def from_env(cls, env=None) -> Config:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is not None:
                given[f.name] = held(f.name, raw) if f.name in RANGES else raw.strip().lower()
        return cls(**given)

    @property
    def keep_messages(self) -> int:
        return 2 * int(held("history_turns", self.history_turns))

    @property
    def min_chunk_chars(self) -> int:
        return max(1, int(self.chunk_size * self.chunk_min_ratio))
