"""Plain Python answers for small inputs."""

import re
from collections import Counter

from termloom.vocab import STOP_WORDS


def kept(text, stop_words=STOP_WORDS):
    tokens = [t for t in re.split("[^A-Za-zА-Яа-я0-9_]+", text.lower()) if t]
    return [
        (pos, t)
        for pos, t in enumerate(tokens)
        if len(t) >= 3 and re.fullmatch("[a-z][a-z'-]*[a-z]", t) and t not in stop_words
    ]


def ranked_keywords(text, non_nouns=(), params=None):
    """[(keyword, n, score, rank, first_pos)] by the definition."""
    two = params.bigram_min_freq if params else 2
    three = params.trigram_min_freq if params else 2
    top = params.max_keywords if params else 50
    words = kept(text)
    tenths, first, size = Counter(), {}, {}
    for at, (pos, w) in enumerate(words):
        tenths[w] += 10 + min(3 * len(w), 30) + 30 * (pos < 150) + 50 * (pos < 50) + 80 * (w not in non_nouns)
        first.setdefault(w, at)
        size[w] = 1
    for n, weight, least in ((2, 60, two), (3, 90, three)):
        counts = Counter()
        for at in range(len(words) - n + 1):
            phrase = " ".join(w for _, w in words[at : at + n])
            counts[phrase] += 1
            first.setdefault(phrase, at)
            size[phrase] = n
        tenths.update({p: c * weight for p, c in counts.items() if c >= least})
    best = sorted(tenths, key=lambda t: (-tenths[t], size[t], first[t]))[:top]
    return [(t, size[t], (tenths[t] + 5) // 10, r, first[t]) for r, t in enumerate(best, 1)]
