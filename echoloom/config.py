"""Query parameters with their defaults and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from typing import Any


class ParameterError(ValueError):
    """A parameter outside its limits."""


def _within(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ParameterError(f"{name} must be between {low} and {high}, not {value}")


@dataclass(frozen=True)
class LexicalConfig:
    """The defaults of a lexical pass."""

    min_repetitions: int = 2
    sentence_min_tokens: int = 12
    sentence_shingle_size: int = 3
    paragraph_min_tokens: int = 8
    paragraph_shingle_size: int = 5
    phrase_tokens: int = 12
    phrase_stride: int = 6
    sentence_jaccard_threshold: float = 0.82
    paragraph_jaccard_threshold: float = 0.72
    block_jaccard_threshold: float = 0.70
    max_df_fraction: float = 0.35
    max_candidate_fanout: int = 64
    block_min_paragraphs: int = 2
    block_min_words: int = 80


@dataclass(frozen=True)
class AnalysisParams:
    """Parameters of a single embedding pass."""

    window_size: int
    stride: int
    tokens_per_page: int | None = None
    chapter_break_regex: str | None = None
    min_repetitions: int = 2
    min_samples: int = 3
    enable_hdbscan: bool = True
    link_subphrases: bool = False

    def __post_init__(self) -> None:
        _within("window_size", self.window_size, 5, 1500)
        _within("stride", self.stride, 1, 200)
        if self.stride > self.window_size:
            raise ParameterError("stride must not exceed window_size")
        if self.tokens_per_page is not None:
            _within("tokens_per_page", self.tokens_per_page, 200, 2000)
        _within("min_repetitions", self.min_repetitions, 2, 20)
        _within("min_samples", self.min_samples, 1, 10)
        if self.chapter_break_regex:
            try:
                re.compile(self.chapter_break_regex)
            except re.error as e:
                raise ParameterError(f"chapter_break_regex: {e}") from e


@dataclass(frozen=True)
class PassSpec:
    name: str
    scope: str  # act | chapter
    method: str = "embedding"  # embedding | lexical
    window_size: int = 0
    stride: int = 0


@dataclass(frozen=True)
class MultiPassConfig:
    passes: tuple[PassSpec, ...]
    min_repetitions: int = 2
    min_samples: int = 3
    enable_hdbscan: bool = True
    link_subphrases: bool = False
    expand_to_sentences: bool = True
    tokens_per_page: int = 400
    lexical: LexicalConfig = field(default_factory=LexicalConfig)

    def __post_init__(self) -> None:
        if not self.passes:
            raise ParameterError("a bundle needs at least one pass")
        names = [p.name for p in self.passes]
        if len(set(names)) < len(names):
            raise ParameterError("pass names must be unique")
        for p in self.passes:
            if p.scope not in ("act", "chapter") or p.method not in ("embedding", "lexical"):
                raise ParameterError(f"pass {p.name}: unknown scope or method")
            if p.method == "embedding":
                AnalysisParams(p.window_size, p.stride, self.tokens_per_page, None, self.min_repetitions, self.min_samples)
        # the bundle's repetitions hold for its lexical passes too
        object.__setattr__(self, "lexical", replace(self.lexical, min_repetitions=self.min_repetitions))

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> MultiPassConfig:
        """A flat mapping, or one wrapped in ``similarity_map`` or ``generate.similarity_map``."""
        if isinstance(raw.get("generate"), dict):
            raw = raw["generate"]
        raw = raw.get("similarity_map", raw)
        known = {f.name for f in fields(cls)} - {"passes", "lexical"}
        lexical = {k: v for k, v in (raw.get("lexical") or {}).items() if k in {f.name for f in fields(LexicalConfig)}}
        return cls(
            passes=tuple(PassSpec(**p) for p in raw.get("passes", ())),
            lexical=LexicalConfig(**lexical),
            **{k: v for k, v in raw.items() if k in known},
        )

    @classmethod
    def from_yaml(cls, text: str) -> MultiPassConfig:
        import yaml

        return cls.from_dict(yaml.safe_load(text) or {})

    def to_yaml(self) -> str:
        import yaml
        from dataclasses import asdict

        body = asdict(self)
        body["passes"] = [dict(p) for p in body["passes"]]
        return yaml.safe_dump({"similarity_map": body}, sort_keys=False)


LEXICAL = PassSpec("lexical", "chapter", "lexical")
ACT_FINE = PassSpec("act_fine", "act", "embedding", 50, 10)
ACT_MID = PassSpec("act_mid", "act", "embedding", 100, 25)
CHAPTER_MID = PassSpec("chapter_mid", "chapter", "embedding", 200, 50)
CHAPTER_COARSE = PassSpec("chapter_coarse", "chapter", "embedding", 400, 100)
PRESETS = {
    "act_fine": MultiPassConfig((LEXICAL, ACT_FINE, ACT_MID)),
    "chapter_coarse": MultiPassConfig((LEXICAL, CHAPTER_MID, CHAPTER_COARSE)),
    "full_multi_pass": MultiPassConfig((LEXICAL, ACT_FINE, ACT_MID, CHAPTER_MID, CHAPTER_COARSE)),
}


def min_cluster_size(min_repetitions: int, window_size: int, stride: int) -> int:
    return min_repetitions * max(1, window_size // max(1, stride))
