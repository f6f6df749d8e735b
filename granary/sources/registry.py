"""Model families and their contexts: what a generator or tokenizer plug-in is configured with."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Family:
    name: str
    context: int


# Context lengths by family.
FAMILIES = {f.name: f for f in (Family("codellama", 16_384), Family("starcoder", 8_192), Family("deepseek", 16_384))}


@dataclass(frozen=True)
class Decoding:
    """How a generator decodes; it samples unless the temperature is 0."""

    max_new_tokens: int = 512
    temperature: float = 0.0
    top_p: float = 1.0
    max_length: int = 99_999_999

    @property
    def sampled(self) -> bool:
        return self.temperature != 0

    def new_tokens(self, used: int, context: int) -> int:
        """Tokens that may follow an input of ``used`` tokens; an input that fills the context is refused."""
        if used >= context:
            raise ValueError(f"an input of {used} tokens fills the context of {context}")
        return min(context - used, self.max_new_tokens, self.max_length - used)
