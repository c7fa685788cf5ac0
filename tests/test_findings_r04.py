"""Findings of the fourth review: the fault each one names, on small inputs."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.functions.text import _ratio
from tidemark.operators import titles as S

WORDS = "Oil prices rise on supply fears Fed holds rates steady again chip maker beats forecasts bank sues regulator over fine über naïve \U0001f600".split()


def titles_of(rng, lengths, each):
    """Families of near copies around titles of some lengths, and the same words in another order: their letters are the same, their ratio is low."""
    texts = set()
    for n in lengths:
        for _ in range(each):
            base = []
            while sum(map(len, base)) + len(base) <= n:
                base.append(rng.choice(WORDS))
            for k in range(6):
                words = list(base)
                if k % 2:
                    rng.shuffle(words)
                t = list(" ".join(words)[:n])
                for _ in range(rng.randint(0, max(1, n // 5))):
                    t.insert(rng.randrange(len(t) + 1), rng.choice("z\udc80")) if rng.random() < 0.5 or len(t) < 2 else t.pop(rng.randrange(len(t)))
                texts.add("".join(t))
    return sorted(texts)


# ---------------------------------------------------------------- F1: pairs of titles that share many letters

@pytest.mark.parametrize("masks", [8_000_000, 3000])
def test_no_bound_loses_a_similar_pair(monkeypatch, masks):
    """Every bound at work (leaves, letters, kinds of letters, many and few bit masks) against all pairs; lengths of one and of several machine words."""
    for name, value in {"_LEAF": 8, "_WIDE": 16, "_PAIRS": 32, "_KIND": 10, "_MASKS": masks}.items():
        monkeypatch.setattr(S, name, value, raising=False)
    rng, found = random.Random(6), 0
    for lengths in ((1, 2, 3), (20, 24), (60, 66, 70), (125, 130, 150), (250, 300)):
        texts = titles_of(rng, lengths, 8)
        for threshold in (85.0, 60.0):
            half = len(texts) // 3
            within = [(int(i), int(j)) for a, b in S.similar_in(texts, None, threshold) for i, j in zip(a, b)]
            across = [(int(i), half + int(j)) for a, b in S.similar_in(texts[:half], texts[half:], threshold) for i, j in zip(a, b)]
            want = {(i, j) for i, t in enumerate(texts) for j, u in enumerate(texts[:i]) if _ratio(t, u) > threshold}
            assert len(within) == len(want) and {(max(p), min(p)) for p in within} == want
            assert len(across) == len(set(across)) and {(j, i) for i, j in across} == {(i, j) for i, j in want if j < half <= i}
            found += len(want)
    assert found > 500


@pytest.mark.parametrize("texts", [["a"], ["a", "b"], ["a" * 99] + ["a" * k for k in range(90, 110)], ["ab" * 60, "a" * 120, "b" * 120, "ba" * 59, "\u4e00" * 119 + "\U0001f600"]])
def test_titles_of_few_letters(texts):
    """A kind of letters that no title of a leaf has, single titles, and titles of one letter."""
    for left, right in ((texts, None), (texts[:1], texts)):
        got = sorted((int(i), int(j)) for a, b in S.similar_in(left, right, 85.0) for i, j in zip(a, b))
        pairs = [(i, j) for i, t in enumerate(left) for j, u in enumerate(right or left) if _ratio(t, u) > 85]
        assert sorted(map(sorted, got)) == sorted(map(sorted, pairs if right else [(i, j) for i, j in pairs if i < j]))


def test_titles_that_share_letters_are_not_all_compared_in_full(monkeypatch):
    """Titles of the same language share most of their letters. Before, each pair that shares enough of them was compared letter by letter."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(45)) for _ in range(160)]
    alike = [(t, u) for k, t in enumerate(texts) for u in texts[:k] if 200 * (Counter(t) & Counter(u)).total() > 85 * (len(t) + len(u))]
    seen, common = [], S._common
    monkeypatch.setattr(S, "_common", lambda *args: seen.append(int(np.sum(args[-2].n[args[-1]]))) or common(*args))
    assert not [p for p, _ in S.similar_in(texts, None, 85.0) if len(p)]
    assert len(alike) > 3000 and 0 < sum(seen) < 0.5 * sum(min(len(t), len(u)) for t, u in alike)
