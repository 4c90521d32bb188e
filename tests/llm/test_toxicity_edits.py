"""Misspelled terms of the lexicon: edits anywhere in a word, also where a short stem of it was learnt, and in long words."""

import random

import numpy as np
import pyarrow as pa

from rulemill.llm import common as C
from rulemill.llm import toxicity

TERMS = ["idiot", "worthless", "disgusting", "pathetic"]


def test_edits_in_the_first_letters_of_learnt_terms(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        if i % 3 == 0:
            words[5] = words[20] = TERMS[i // 3 % 4]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    odd = ["ldiot", "idoit", "wrothless", "dsgusting", "pahtetic", "diot", "patthetic", "idiotic" * 12]
    rows += [(1000 + k, f"w1 w2 {w} w3") for k, w in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {odd[r["doc_id"] - 1000]: r["n_hits"] for r in got if r["doc_id"] >= 1000} == dict.fromkeys(odd, 1)


def test_no_word_within_an_edit_is_left_out():
    def far(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    def want(word):
        near = [far(word, t) for t in TERMS + ["año", "señorito"] if abs(len(word) - len(t)) < 2 and far(word, t) <= (len(t) >= 5)]
        near += [d for d in (min(far(word[:k], "grumbl") for k in range(min(len(word), 8) + 1)),) if d <= 1]
        return min(near, default=-1) + 1

    rng = random.Random(5)
    words = [w for t in TERMS + ["año", "señorito", "grumbl"] for w in [t, *(t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(len(t) - 1))]]
    for w in [*words, "grumbling" + "x" * 90] * 20:
        i, how = rng.randrange(len(w) + 1), rng.random()
        words.append(w[:i] + (rng.choice("abdgiost") if how < 0.7 else "") + w[i + (how > 0.3) :])
    text = " ".join(words).encode()
    a = C.LOWER[np.frombuffer(text, np.uint8)]
    s, e, _ = C.word_spans(a, np.array([0, len(a)]), C.NOT_ALNUM)
    got = toxicity.Matcher([*TERMS, "año", "señorito", "grumbl*"]).hits(a, C.rolling(a), s, e)
    assert {w: int(g) for w, g in zip(words, got, strict=True) if w} == {w: want(w) for w in words if w}
