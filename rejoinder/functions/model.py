"""Model clients: the protocol and retrying."""

from __future__ import annotations

import random
import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple, Protocol


class ModelClient(Protocol):
    def generate(self, prompts: Sequence[str]) -> list[str]:
        """One reply per prompt, in the same order."""


class Permanent(Exception):
    """Raised by a client for a prompt that would fail again: it is not tried a second time."""


# Errors of the program and not of the service.
CODING_ERRORS = (TypeError, AttributeError, NameError, LookupError, ImportError, NotImplementedError, AssertionError, SyntaxError)


class Answer(NamedTuple):
    raw: str | None
    error: str | None
    attempts: int
    latency_s: float
    permanent: bool = False


@dataclass(frozen=True)
class Retry:
    """How often a prompt is tried, how long to wait in between (doubled each time), and what is not tried again."""

    max_attempts: int = 10
    first_wait_s: float = 0.5
    longest_wait_s: float = 20.0
    permanent: tuple[type[BaseException], ...] = (Permanent, *CODING_ERRORS)

    def wait(self, attempt: int) -> None:
        if self.first_wait_s > 0:
            longest = min(self.first_wait_s * 2 ** (attempt - 1), self.longest_wait_s)
            time.sleep(longest * random.uniform(0.5, 1.0))


def ask(client: ModelClient, prompts: list[str], retry: Retry, attempt: int = 1) -> list[Answer]:
    """Send prompts together; when that fails, send halves, then single prompts until they run out."""
    started = time.monotonic()
    try:
        raws = list(client.generate(prompts))
        if len(raws) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts but {len(raws)} replies")
    except Exception as problem:
        permanent = isinstance(problem, retry.permanent)
        if len(prompts) == 1 and (permanent or attempt >= retry.max_attempts):
            error = f"{type(problem).__name__}: {problem}"
            return [Answer(None, error, attempt, time.monotonic() - started, permanent)]
        if not permanent:
            retry.wait(attempt)
        if len(prompts) == 1:
            return ask(client, prompts, retry, attempt + 1)
        half = len(prompts) // 2
        # a failed group call counts against none of its members
        return ask(client, prompts[:half], retry, attempt) + ask(client, prompts[half:], retry, attempt)
    took = time.monotonic() - started
    return [Answer(raw, None, attempt, took) for raw in raws]
