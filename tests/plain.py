"""The rules restated in plain Python, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter


def sentences(text):
    return [p.strip() + "." for p in text.split(".") if p.strip()]


def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def vocabulary(texts):
    counts = Counter(t for text in texts for t in tokens(text))
    return {t: i for i, t in enumerate(["<pad>", "<unk>", "<bos>", "<eos>"] + [t for t, _ in counts.most_common()])}


def encode(text, vocab):
    return [vocab.get(t, 1) for t in tokens(text)]


def draw(seed, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 2**32


def letters(word):
    """A word's characters and its end; a word that spells the end mark is kept from making it."""
    return [*word.replace("</w>", "<\ufdd0/w>"), "</w>"]


def merge(symbols, pair):
    """Symbols as one string with a bar on each side; the pair's inner bars go, from left to right."""
    left, right = map(re.escape, pair)
    barred = "\0" + "\0".join(symbols) + "\0"
    return re.sub(f"(?<=\0){left}\0{right}(?=\0)", lambda m: m[0].replace("\0", ""), barred)[1:-1].split("\0")


def train_bpe(texts, limit):
    words = Counter(w for t in texts for w in t.split())
    table = {w: letters(w) for w in words}
    learned = []
    for _ in range(limit):
        pairs = Counter()
        for w, f in words.items():
            for pair in zip(table[w], table[w][1:]):
                pairs[pair] += f
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()))
        learned.append((*best, pairs[best]))
        table = {w: merge(s, best) for w, s in table.items()}
    return learned, table


def bigrams(lists):
    return Counter(p for ids in lists for p in zip(ids, ids[1:]))


def loss(counts, v, alpha, context, target):
    total = sum(f for (c, _), f in counts.items() if c == context)
    return -math.log((counts[(context, target)] + alpha) / (total + alpha * v))


def nucleus(scores, temperature, k, p, ties):
    """Filtered and normalised candidates of one context in draw order, from a dict token -> score."""
    ranked = sorted(((s / temperature, t) for t, s in scores.items()), key=lambda x: (-x[0], x[1]))
    if ties:
        kept = [x for x in ranked if x[0] >= ranked[min(k, len(ranked)) - 1][0]]
    else:
        kept = ranked[:k]
    top = kept[0][0]
    weights = [(math.exp(s - top), t) for s, t in kept]
    total = sum(w for w, _ in weights)
    out, mass = [], 0.0
    for w, t in weights:
        if mass > p + 1e-9:
            break
        out.append((t, w / total))
        mass += w / total
    return [(t, q / sum(x for _, x in out)) for t, q in out]
