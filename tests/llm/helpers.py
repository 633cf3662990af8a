"""Brute-force versions of the operators' results, in plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 3) -> list[tuple[int, str | None]]:
    """Documents with copies, near copies, shared passages, runs of one word, and odd ones; doc_ids in no order."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 150)
    texts: list[str | None] = [None, "", " \n\t", "one", "One two", "one two three four", "ONE two\tthree  four", "the " * 200, "a b " * 90, "a b c " * 70]
    texts += [base] * 30
    for _ in range(25):
        words = base.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99999)}"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, rng.randrange(5, 80))} {passage} {prose(rng, rng.randrange(5, 80))}" for _ in range(12)]
    texts += [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    texts += [prose(rng, 9000), "Großes übung é à 日本語 " * 12]
    ids = rng.sample(range(10000), len(texts))
    return list(zip(ids, texts))


def components(sets: dict[int, frozenset], num: int, den: int) -> dict[int, int]:
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared * den >= num * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text: str | None, n: int) -> frozenset:
    w = BLANK.findall(lower(text))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def repeats(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = BLANK.findall(text or "")
        cover = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                cover[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(cover), " ".join(x for x, c in zip(w, cover) if not c))
    return out


def leaks(docs, items, window: int):
    owners = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[k : k + window])].add(i)
    sizes = sorted({len(k) for k in owners})
    out = {}
    for i, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                who = owners.get(tuple(w[k : k + n]))
                if who:
                    found |= who
                    hit[k : k + n] = [True] * n
        out[i] = (len(w), sum(hit), sorted(map(str, found)))
    return out
