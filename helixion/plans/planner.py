"""Driver-side planning of noise removal: Poisson model, error profile, rounds, filter size."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass


def poisson_pdf(x: float, mean: float) -> float:
    if x < 0:
        return 0.0
    return math.exp(x * math.log(mean) - mean - math.lgamma(x + 1)) if mean > 0 else float(x == 0)


def poisson_cdf(x: float, mean: float) -> float:
    return min(1.0, math.fsum(poisson_pdf(i, mean) for i in range(int(math.floor(x)) + 1))) if x >= 0 else 0.0


def truncated_cdf(x: float, mean: float) -> float:
    """Of a Poisson count given that it is at least 1."""
    zero = math.exp(-mean)
    return (poisson_cdf(x, mean) - zero) / (1 - zero)


def truncated_pdf(x: float, mean: float) -> float:
    """The zero-truncated probability of x >= 1."""
    return 0.0 if x < 1 else poisson_pdf(x, mean) / (1 - math.exp(-mean))


def shifted_pdf(x: float, mean: float) -> float:
    """(pdf(x) - pdf(0)) / (1 - pdf(0)): the form some callers expect instead of the truncated one."""
    zero = poisson_pdf(0, mean)
    return (poisson_pdf(x, mean) - zero) / (1 - zero)


def rounds_for_loss(mean: float, loss: float) -> int:
    """The first number of rounds n at which a k-mer of the mean multiplicity has at most n occurrences with more than the tolerated probability."""
    n = 0
    while n <= mean + 40 * math.sqrt(mean) + 100 and truncated_cdf(n, mean) <= loss:
        n += 1
    return n


def false_removal(mean: float, blocks: list[int]) -> float:
    """Probability that a true k-mer falls at most once into each of the blocks between rounds: sum over x of x! e_x(p) Poisson(x)."""
    total = sum(blocks)
    symmetric = [1.0] + [0.0] * len(blocks)  # elementary symmetric polynomials, one block at a time
    for b in blocks:
        for x in range(len(blocks), 0, -1):
            symmetric[x] += symmetric[x - 1] * b / total
    return math.fsum(math.factorial(x) * symmetric[x] * poisson_pdf(x, mean) for x in range(1, len(blocks) + 1))


def block_subsets(n: int, x: int):
    """All choices of x of n blocks."""
    return itertools.combinations(range(n), x)


def true_windows(profile: list[float], k: int) -> float:
    """Expected error-free windows of k bases in a read with these error rates by place."""
    return math.fsum(math.prod(1 - e for e in profile[i : i + k]) for i in range(len(profile) - k + 1))


def true_to_false(profile: list[float], k: int) -> float:
    """Ratio of error-free windows to others; infinite without errors. A profile shorter than k is refused."""
    if len(profile) < k:
        raise ValueError("the error profile is shorter than k")
    t, n = true_windows(profile, k), len(profile) - k + 1
    return math.inf if n - t <= 0 else t / (n - t)


def read_profile(path: str) -> list[float]:
    """Whitespace-separated error rates, one per base."""
    with open(path) as f:
        return [float(x) for x in f.read().split()]


@dataclass(frozen=True)
class Plan:
    true_total: int
    false_total: int
    mean: int
    initial_rounds: int
    rounds: int
    slots: int
    qb: int
    hb: int
    trigger: int
    upper_rounds: int
    """Most rounds of a filter of this size; 0 where there is no bound."""
    bounded: bool = False
    """Whether upper_rounds is a bound."""


def _slots(n: int, digits: int, false_total: int, rounds: int) -> int:
    return int(n * (digits + 1.5) + false_total * 10 // ((rounds + 1) * 9))


def plan(k: int, n_true: int, total: int, alpha: float | None = None, profile: list[float] | None = None, rounds: int = -1, loss: float = 0.0) -> Plan:
    """Rounds, filter size and trigger from k, true distinct k-mers, all k-mers, and an error rate (which wins) or profile.

    rounds < 0 derives them from the tolerated loss (0: one true k-mer). Given
    or derived, they are lowered to the fewest with the same power-of-two size.
    """
    if alpha is not None:
        true_total = int(total * (1 - alpha) ** k)
    elif profile is not None:
        ratio = true_to_false(profile, k)
        true_total = total if math.isinf(ratio) else int(total * ratio / (1 + ratio))
    else:
        raise ValueError("an error rate or an error profile is needed")
    false_total, mean = total - true_total, true_total // n_true
    first = rounds if rounds >= 0 else rounds_for_loss(mean, loss or 1 / n_true)
    digits = max(1, math.ceil((mean + 1).bit_length() / 7))
    slots = _slots(n_true, digits, false_total, first)
    qb = max(1, (slots - 1).bit_length())
    size = 1 << qb
    low = first
    while low and _slots(n_true, digits, false_total, low - 1) <= size - 1:
        low -= 1
    upper, bounded, half = 0, False, size >> 1
    if int(n_true * (digits + 1.5)) < half:
        # More rounds never need more slots: bisect for the most that still need at least half the size.
        under, over = first, max(1, first)
        while _slots(n_true, digits, false_total, over) >= half:
            under, over = over, over * 2
        while over - under > 1:
            mid = (under + over) // 2
            under, over = (mid, over) if _slots(n_true, digits, false_total, mid) >= half else (under, mid)
        upper, bounded = under, True
    return Plan(true_total, false_total, mean, first, low, slots, qb, qb + 8, n_true + false_total // (low + 1), upper, bounded)


@dataclass(frozen=True)
class Recipe:
    n_true: int
    error: float


def recipe(f0: int, f1_total: int, f1: int, f2: int, k: int) -> Recipe:
    """True distinct k-mers and error rate from a histogram's head: distinct, occurrences, seen once, seen twice."""
    return Recipe(f0 - f1 - f2, 1 - ((f1_total - f1 - 2 * f2) / f1_total) ** (1 / k))


def loss_after(n_total: int, n_distinct: int, rounds: int, end_round: bool = False) -> float:
    """Estimate of lost true k-mers after a build: Poisson at the rounds run, with the mean multiplicity found."""
    return poisson_cdf(rounds + end_round, n_total / n_distinct) if n_distinct else 0.0
