"""All pairs scored one by one in plain Python: what the matcher must agree with on small fixtures."""

from __future__ import annotations

import math
import re
from collections import Counter
from difflib import SequenceMatcher


def normalize(name):
    return " ".join(re.sub(r"[^\w\s]", " ", (name or "").lower()).split())


def grams(clean):
    toks = [w for w in clean.split() if len(w) > 1]
    return [" ".join(toks[i : i + n]) for n in (1, 2, 3) for i in range(len(toks) - n + 1)]


class Lexicon:
    def __init__(self, rows):
        self.target = {}
        for src, target in rows:
            known = self.target.get(src)
            self.target[src] = target if known is None or (target is not None and target > known) else known
        self.srcs = sorted((src for src, _ in rows), key=lambda s: (s is None, s or ""))
        docs = [grams(normalize(s)) for s in self.srcs]
        counts = Counter(t for d in docs for t in d)
        df = Counter(t for d in docs for t in set(d))
        top = sorted(counts, key=lambda t: (-counts[t], t))[:1000]
        self.idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in top}

    def vector(self, clean):
        tf = Counter(t for t in grams(clean) if t in self.idf)
        raw = {t: n * self.idf[t] for t, n in tf.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / length for t, w in raw.items()}

    def scores(self, a, b):
        wa, wb = set(a.split()), set(b.split())
        exact = float(a == b)
        inside = float(a in b or b in a)
        seq = SequenceMatcher(None, a, b).ratio()
        overlap = len(wa & wb) / len(wa | wb) if wa | wb else 0.0
        va, vb = self.vector(a), self.vector(b)
        cosine = sum(w * vb.get(t, 0.0) for t, w in va.items())
        basic = exact * 0.4 + inside * 0.2 + seq * 0.2 + overlap * 0.2
        return (basic * 0.7 + cosine * 0.3 if self.idf else basic), exact, inside, seq, overlap, cosine

    def match(self, name, top_n, threshold):
        a = normalize(name)
        scored = [(self.scores(a, normalize(src)), src) for src in self.srcs]
        kept = [row for row in scored if row[0][0] >= threshold]
        kept.sort(key=lambda row: (-round(row[0][0], 10), row[1] is None, row[1] or ""))
        return [
            (src, self.target[src] or "UNMAPPED", *(round(x, 4) for x in scores), rank)
            for rank, (scores, src) in enumerate(kept[:top_n], 1)
        ]
