"""Named variants: arms of a comparison, reconciliation policies and decoder settings."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Tables that hold one arm's readings each.
ARMS = {"engine": "pipeline_raw_engine", "engine_off": "pipeline_raw_engine_off", "pre_wordlm": "pipeline_raw_pre_wordlm"}


@dataclass(frozen=True)
class Decoder:
    """How class scores become text: greedily (width 1) or by beam, with the language model's weight."""

    width: int = 1
    lm_weight: float = 0.0
    word_weight: float = 0.0


DECODERS = {"greedy": Decoder(), "beam": Decoder(width=4), "beam_char_lm": Decoder(4, 0.3), "beam_word_lm": Decoder(4, 0.3, 0.5)}


@dataclass(frozen=True)
class Policy:
    """Which sources of values count, and how many must agree."""

    sources: tuple[str, ...] = ("first", "second")
    agree: int = 1


POLICIES = {"any": Policy(), "first_only": Policy(("first",)), "both": Policy(agree=2)}


@dataclass
class Registry:
    """Names to variants of one kind; a name is given once."""

    known: dict = field(default_factory=dict)

    def add(self, name: str, variant) -> None:
        if name in self.known:
            raise ValueError(f"{name} is already registered")
        self.known[name] = variant

    def get(self, name: str):
        if name not in self.known:
            raise KeyError(f"{name} is not one of {', '.join(sorted(self.known))}")
        return self.known[name]
