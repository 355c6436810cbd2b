import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthspan.llm import phrases, quotient

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, most, longest=5):
    found, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                found[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        n = total[lang]
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                covered |= {q for i in range(len(p) - k + 1) if 100 * a >= 100 * f[q := p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    names = ["the", "The", "a", "of", "bank", "river", "new", "york", "city", "été", "x-y", "ünï", "日本", "b"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice([["New", "York", "City"], ["the", "river", "bank", "of", "the"], [rng.choice(names)], [rng.choice(names) + rng.choice(".,;:!?\n\r\t ")], [f"rare{rng.randrange(400)}"]])
        rows.append((rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "en", "fr", None])))
    return rows


ODD = [(None, "en"), ("", None), (" \n\t.,;", "de"), ("new york city", "en"), ("new york city", "en"), ("alone", "xx"), ("over and over again " * 20000, "en")]


@pytest.mark.parametrize("most_words,per_range,most", [(10**6, 1 << 19, 2000), (0, 50, 7), (10**6, 200, 25)])
def test_collocations_against_brute_force(docs_of, most_words, per_range, most):
    rows = corpus() + ODD
    got = phrases.collocations(docs_of([(i, t, lang, "a") for i, (t, lang) in enumerate(rows)]).repartition(5), least=6, most=most, most_words=most_words, per_range=per_range)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 6, most)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_nothing_frequent_and_empty(docs_of):
    assert phrases.collocations(docs_of([])).count() == 0
    assert phrases.collocations(docs_of([(1, "some words only"), (2, None)])).count() == 0
    assert phrases.collocations(docs_of([(i, f"word{i} same") for i in range(9)]), least=5).count() == 0


def test_scores_pass_64_bits(spark):
    a, n, l, r = 9 * 10**14, 8 * 10**17, 10**15, 3 * 10**15
    df = spark.createDataFrame([(a, n, l, r)], "a long, total long, l long, r long")
    got = df.selectExpr("(cast(a as decimal(19,0)) * cast(total as decimal(19,0)) * 1000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s").first().s
    assert got == 1000 * a * n // (l * r)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5), st.integers(1, 32), st.integers(1, 400), st.integers(0, 8), st.integers(0, 1 << 30))
def test_filters_give_back_what_they_hold(k, b, n, prefix, seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 1 << b, n).astype(np.uint64) for _ in range(k)]
    assert all((x == y).all() for x, y in zip(quotient.turned(quotient.turned(words, b), b, back=True), words))
    limbs, counts = quotient.counted(quotient.packed(words, b))
    counts = counts + rng.choice([0, 0, 300, 10**12], len(counts))
    want = Counter()
    for i, c in enumerate(counts):
        want[sum(int(x[i]) << (64 * j) for j, x in enumerate(limbs))] += int(c)
    assert len(want) == len({tuple(int(w[i]) for w in words) for i in range(n)})
    again, same = quotient.decoded(quotient.encoded(limbs, counts, k * b), len(limbs))
    assert {sum(int(x[i]) << (64 * j) for j, x in enumerate(again)): int(c) for i, c in enumerate(same)} == want
    twice, sums = quotient.counted([np.concatenate([x, x]) for x in limbs], np.concatenate([counts, counts]))
    assert (sums == 2 * counts).all() and all((x == y).all() for x, y in zip(twice, limbs))
    assert all((x == y).all() for x, y in zip(quotient.unpacked(quotient.packed(words, b), k, b), words))
