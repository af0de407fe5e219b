"""Example callables for the scorer slots (F5 matcher, M4 scorer).

Deterministic stand-ins for a hosted model, used by the registered queries
and tests; a real deployment passes its own client here. They live in the
package so executors can import them (see ``session.ship_package``).
"""

from __future__ import annotations

import json

# The demo reviewer's threshold and its notes.
PRICE_LIMIT = 100000.0
ABOVE = "price above limit"
AT_OR_BELOW = "price at or below limit"


def same_initial(term: str, values: list[str]):
    """F5 matcher: values that start with the term's first letter."""
    head = term[:1].lower()
    return [(v, "same first letter") for v in values if v[:1].lower() == head]


def length_scorer(prompt: str) -> str:
    """M4 scorer: fails on prompts of odd length, else reports the length."""
    if len(prompt) % 2 == 1:
        raise ValueError("odd length")
    return f"ok:{len(prompt)}"


def first_scorer(prompt: str) -> str:
    """M4 scorers that tell who answered."""
    return f"first:{len(prompt)}"


def second_scorer(prompt: str) -> str:
    return f"second:{len(prompt)}"


def first_answers(term: str, values: list[str]):
    """F5 matchers that tell who answered: values that end in an even digit."""
    return [(v, "first") for v in values if int(v[-1]) % 2 == 0]


def second_answers(term: str, values: list[str]):
    return [(v, "second") for v in values if int(v[-1]) % 2 == 0]


def price_reviewer(prompt: str) -> str:
    """M4 reviewer: reads the records of a review request (one JSON object
    per line) and judges each by its total price, echoing its fields the way
    a model would, inside free text."""
    out = []
    for line in prompt.split("\n"):
        if not line.startswith('{"'):
            continue
        rec = json.loads(line)
        ok = rec.get("o_totalprice") is not None and rec["o_totalprice"] > PRICE_LIMIT
        rec["Meets Guidelines"] = "True" if ok else "False"
        rec["Notes on Compliance"] = ABOVE if ok else AT_OR_BELOW
        out.append(rec)
    return "Here is the review:\n" + json.dumps(out)


def advising_reviewer(prompt: str) -> str:
    """``price_reviewer`` that also recommends what to do with accepted records."""
    records = json.loads(price_reviewer(prompt).split("\n", 1)[1])
    for rec in records:
        if rec["Meets Guidelines"] == "True":
            rec["Recommendation"] = "accept"
    return json.dumps(records)
