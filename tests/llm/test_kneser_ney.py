"""The language model against a plain Kneser-Ney model in dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from accordance.llm import language


def grams(text: str) -> list[tuple]:
    codes = ["<"] * 3 + [("0" if c.isdigit() else c.lower()) for c in text]
    return [tuple(codes[i - 3 : i + 1]) for i in range(3, len(codes))]


class Plain:
    def __init__(self, texts: list[str], floor: float):
        counts = {4: Counter(g for t in texts for g in grams(t))}
        for order in (3, 2, 1):
            counts[order] = Counter(g[1:] for g in counts[order + 1])
        self.p, self.share, self.floor = {(): math.exp(floor)}, {}, floor
        for order in (1, 2, 3, 4):
            n = counts[order]
            n1, n2 = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total, kinds = defaultdict(int), Counter(g[:-1] for g in n)
            for g, v in n.items():
                total[g[:-1]] += v
            for c in total:
                self.share[order, c] = d * kinds[c] / total[c]
            for g, v in n.items():
                self.p[g] = self.share[order, g[:-1]] * self.p[g[1:]] + max(v - d, 0) / total[g[:-1]]

    def log(self, gram: tuple) -> float:
        if not gram:
            return self.floor
        if gram in self.p:
            return math.log(self.p[gram])
        share = self.share.get((len(gram), gram[:-1]))
        return self.log(gram[1:]) + (math.log(share) if share is not None else 0.0)


def test_cross_entropies_equal_a_plain_model(spark):
    rng = random.Random(6)
    words = {"aa": ["kata", "molo", "ri", "Tena9", "so"], "bb": ["schun", "drei7", "und", "kata", "ze"], "cc": ["ouil", "que", "été", "ri"]}
    train = [(" ".join(rng.choices(w, k=rng.randrange(1, 30))), lang) for lang, w in words.items() for _ in range(12)] + [("", "aa"), ("kata", "bb")] * 2
    tests = [" ".join(rng.choices(sum(words.values(), []) + ["xyz", "42", "Unbekannt!"], k=rng.randrange(1, 25))) for _ in range(40)]
    unigrams = {g[-1] for t, _ in train for g in grams(t)}
    floor = -math.log(len(unigrams) + 1)
    models = {lang: Plain([t for t, own in train if own == lang], floor) for lang in sorted(words)}
    model = language.fit(spark.createDataFrame(train, "text string, lang string").repartition(3))
    found = language.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()
    assert len(found) == len(tests)
    for r in found:
        own = grams(tests[r["doc_id"]])
        entropy = {lang: -sum(m.log(g) for g in own) / len(own) for lang, m in models.items()}
        best = min(entropy, key=lambda k: (entropy[k], k))
        assert r["cross_entropy"] == pytest.approx(entropy[best], abs=2e-5)
        assert r["lang_pred"] == best or abs(entropy[r["lang_pred"]] - entropy[best]) < 2e-5


def test_packed_ids_round_trip():
    import numpy as np

    for ids in ([], [0], [5], [1, 2, 2, 2, 9, 1 << 63, (1 << 64) - 1]):
        x = np.asarray(ids, np.uint64)
        assert language.unpack_ids(language.pack_ids(x)).tolist() == ids
