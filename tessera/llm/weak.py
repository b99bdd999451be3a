"""Weak supervision on a table of vote patterns: expectation-maximisation for the labelers' rates of each vote."""

from __future__ import annotations

import math

VOTES = (-1, 0, 1)
Rates = dict[tuple[int, bool, int], float]


def posterior(vote: tuple[int, ...], prior: float, rate: Rates) -> float:
    p, q = (math.log(x) + sum(math.log(rate[k, y, v]) for k, v in enumerate(vote)) for x, y in ((prior, True), (1 - prior, False)))
    return 1 / (1 + math.exp(min(700, max(-700, q - p))))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], labelers: int, prior: float, accuracy: float = 0.85, abstain: float = 0.2, weight: float = 20.0, rounds: int = 50, bounds: tuple[float, float] = (0.01, 0.99)) -> tuple[float, Rates]:
    """(prior, rates): P(true), and P(vote of labeler k | true or not), from (votes, count) rows.

    Rates start at the given accuracy, which also counts as `weight` rows, so a labeler that hardly votes keeps it and the two classes
    can't change places. A vote is at least as likely in the class that it names as in the other: where the counts say otherwise, both
    classes get their pooled rate of that vote, which is the most likely one under this order. The table has at most 3**labelers rows
    whatever the corpus holds.
    """
    rate = {(k, y, v): abstain if v == 0 else (1 - abstain) * (accuracy if (v > 0) == y else 1 - accuracy) for k in range(labelers) for y in (True, False) for v in VOTES}
    first, start = dict(rate), prior
    for _ in range(rounds):
        seen = {key: weight * p for key, p in first.items()}
        true = total = 0.0
        for vote, n in patterns:
            p = posterior(vote, prior, rate)
            true, total = true + n * p, total + n
            for k, v in enumerate(vote):
                seen[k, True, v] += n * p
                seen[k, False, v] += n * (1 - p)
        prior = min(bounds[1], max(bounds[0], (true + weight * start) / (total + weight)))
        rate = _ordered(seen, labelers)
    return prior, rate


def _ordered(seen: Rates, labelers: int) -> Rates:
    """Rates of each vote from its weighted counts, under the order above; what is left over is the rate of abstaining."""
    rate: Rates = {}
    for k in range(labelers):
        size = {y: sum(seen[k, y, v] for v in VOTES) for y in (True, False)}
        for v in (-1, 1):
            names, other = v > 0, v < 0
            a, b = seen[k, names, v] / size[names], seen[k, other, v] / size[other]
            if a < b:
                a = b = (seen[k, names, v] + seen[k, other, v]) / (size[True] + size[False])
            rate[k, names, v], rate[k, other, v] = a, b
        for y in (True, False):
            rate[k, y, 0] = max(1e-9, 1 - rate[k, y, 1] - rate[k, y, -1])
    return rate


def log_ratios(rate: Rates, labelers: int) -> list[dict[int, float]]:
    """For each labeler and vote, abstentions too, the log likelihood ratio: with the prior's log odds they add up to the posterior's."""
    return [{v: math.log(rate[k, True, v] / rate[k, False, v]) for v in VOTES} for k in range(labelers)]
