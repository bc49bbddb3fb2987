"""Rule-based replies in place of a language model, for tests and trial runs."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from rejoinder.functions.model import ModelClient


def _between(prompt: str, tag: str) -> str:
    """Text between a tag's first opening and last closing line."""
    found = re.search(rf"<{tag}>\n?(.*)\n?</{tag}>", prompt, re.DOTALL)
    return found.group(1).removesuffix("\n") if found else ""


class StandIn:
    """Fixed rules in place of a language model, for tests and trial runs.

    It checks the plumbing, not the language. Some replies are wrapped, misspelt or broken on
    purpose, as real ones are.
    """

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return [self.reply(prompt) for prompt in prompts]

    def reply(self, prompt: str) -> str:
        task = prompt.split("\n", 1)[0]
        if task == "Task: analyse one review." or task == "Task: answer in four tones.":
            return self._analysis(prompt, tones_only=task == "Task: answer in four tones.")
        if task == "Task: analyse one review with one answer.":
            return self._one_answer(prompt)
        if task == "Task: sum up a list of texts.":
            return self._summary(prompt)
        if task == "Task: choose classes.":
            return self._themes(prompt)
        if task == "Task: revise a text.":
            return f"{_between(prompt, 'text')} [{_between(prompt, 'change')}]"
        if task == "Task: revise in a chat.":
            history = _between(prompt, "history")
            return f"Revised with {len(_between(prompt, 'change').split())} words after {len(history)} characters"
        if task == "Task: reply to a customer.":
            return (
                f"Dear {_between(prompt, 'customer')}: {len(_between(prompt, 'review').split())} words read, "
                f"{len(_between(prompt, 'history'))} characters before"
            )
        if task == "Task: answer feedback.":
            return f"Thank you for {len(_between(prompt, 'feedback').split())} words"
        raise ValueError(f"no rule for {task!r}")

    def _analysis(self, prompt: str, tones_only: bool) -> str:
        words = len(_between(prompt, "review").split())
        if words % 13 == 0:
            return f"I can not answer {words} words"
        name = _between(prompt, "customer")
        default = f"Dear {name}, thank you for {words} words"
        reply: dict = {
            "Default": default,
            "More friendly" if words % 2 else "More_friendly": f"Hi {name}, thanks for {words} words",
            "More_Professional": f"Dear customer {name}, we read {words} words",
            "More_Concise": [f"Thanks, {name}"] if words % 3 == 0 else f"Thanks, {name}",
        }
        if not tones_only:
            survey = json.loads(_between(prompt, "survey"))
            scores = {q.get("q"): q.get("score") for q in survey}
            reply["Summary"] = f"A review of {words} words"
            good = scores.get("quality") == 1 and scores.get("toxic") == 0
            if survey:
                reply["Sentiment"] = "promotor" if good else "non-promoter"
            size = "long text" if words > 100 else "short text"
            reply["Positive Themes" if words % 5 == 0 else "Positive_Themes"] = [size] if good else []
            reply["Negative_Themes"] = [] if good else [size, "survey"] if survey else ["survey"]
        text = json.dumps(reply)
        return f"```json\n{text}\n```" if words % 7 == 0 else text

    def _one_answer(self, prompt: str) -> str:
        words = len(_between(prompt, "review").split())
        survey = _between(prompt, "survey")
        reply: dict = {
            "Response": f"Dear {_between(prompt, 'customer')}, thank you for {words} words",
            "Summary": f"A review of {words} words",
            "Positive_Themes": ["long text" if words > 100 else "short text"],
            "Negative_Themes": [],
        }
        if survey != "None":
            scores = {q.get("q"): q.get("score") for q in json.loads(survey)}
            good = scores.get("quality") == 1 and scores.get("toxic") == 0
            reply["Sentiment"] = "promotor" if good else "non-promoter"
        return json.dumps(reply)

    def _summary(self, prompt: str) -> str:
        texts = words = 0
        for item in json.loads(_between(prompt, "texts")):
            done = re.fullmatch(r"(\d+) texts with (\d+) words\.", item)
            texts += int(done.group(1)) if done else 1
            words += int(done.group(2)) if done else len(item.split())
        return f"{texts} texts with {words} words."

    def _themes(self, prompt: str) -> str:
        words = set(_between(prompt, "comment").split())
        chosen = [c for c in _between(prompt, "classes").split(", ") if c in words]
        chosen.append("Something else")
        n = len(chosen)
        mood = "positive" if n > 3 else "negative" if n == 1 else "neutral"
        return json.dumps({"theme_category": chosen, "sentiment": mood})


def stand_in() -> ModelClient:
    return StandIn()
