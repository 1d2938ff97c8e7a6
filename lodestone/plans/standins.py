"""Backends that stand in for models: each reply depends on its prompt only, so SQL can tell what it is."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

QUESTION = re.compile(r"\nQuestion: (.*)\nAnswer: (.*)\n\n", re.DOTALL)


def by_prompt(reply: Callable[[str], str | None]) -> Callable[[], Callable[[Sequence[str]], list]]:
    return lambda: lambda prompts: [reply(p) for p in prompts]


def grade(prompt: str) -> str | None:
    """Grades from the lengths of question and answer; every eleventh length of a question gets no reply."""
    q, a = (len(x) for x in QUESTION.search(prompt).groups())
    return None if q % 11 == 0 else json.dumps({"clarity": 1 + q % 5, "answerability": 1 + a % 5, "reasoning": 1 + (q + a) % 5})


grader = by_prompt(grade)


def facts(prompt: str) -> str:
    """One fact a chunk: its first word runs to its last; texts of a total length divisible by 13 get no JSON."""
    texts = re.findall(r"Chunk ID: \S+\n([^\n]*)", prompt)
    if sum(map(len, texts)) % 13 == 0:
        return "no facts"
    one = lambda x: {"entity_1": x.split(" ")[0], "relation": "runs to", "entity_2": x.split(" ")[-1], "source_sentence": x.split(". ")[0]}
    return json.dumps({"triplets": [one(x) for x in texts]})


def ask(prompt: str) -> str | None:
    """A question from the first to the last fact, which names what lies between where the first name's length is divisible by 3; none where it is by 7."""
    hops = re.findall(r"\n Entity 1: (.*)\n Relation: (.*)\n Entity 2: (.*)", prompt)
    head, between, tail = hops[0][0], hops[0][2], hops[-1][2]
    if len(head) % 7 == 0:
        return None
    return json.dumps({"question": f"Where does {head} end" + (f" after {between}?" if len(head) % 3 == 0 else "?"), "answer": tail})


def rewrite(prompt: str) -> str:
    """As many words more as the try has."""
    found = re.match(r"Rewrite the question: try ([0-9]+)\.\n(.*)", prompt, re.DOTALL)
    return found[2] + " else" * int(found[1])


def vector(text: str) -> list[float]:
    return [float(len(text) % 17), float(text.count("e"))]


def translate(prompt: str) -> str:
    """Into French e becomes é; into any other language a becomes á."""
    head, _, text = prompt.partition("\n")
    return text.replace("e", "é") if "French" in head else text.replace("a", "á")


def answer(prompt: str) -> str:
    """The number of blanks in the first document's first paragraph."""
    if not prompt.startswith("Documents:\n"):
        return "no such info"
    return f"{prompt.removeprefix('Documents:' + chr(10)).split(chr(10) * 2)[0].count(' ')} blanks"


extractor, asker, rewriter, embedder, translator, answerer = map(by_prompt, (facts, ask, rewrite, vector, translate, answer))
