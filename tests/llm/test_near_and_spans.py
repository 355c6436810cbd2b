import random
import re

import numpy as np
import pytest

from hearthspan.llm import near_dedup, span_dedup
from hearthspan.llm.components import components


def word_list(t):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def shingles(t, k):
    w = word_list(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t, k)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows(odd_rows):
    rng = random.Random(8)
    rows = list(odd_rows)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows += [(1000 + i, edited(rng, base, rng.randrange(9))) for i in range(160)]  # a hot group, linked here and there
    for g in range(25):
        own = [f"g{rng.randrange(5000)}" for _ in range(rng.randrange(3, 120))]
        rows += [(2000 + 10 * g + i, edited(rng, own, rng.randrange(4))) for i in range(3)]
    rows += [(3000 + i, "The Same words in Case OF letters") for i in range(12)] + [(3100, "the same WORDS in case of letters")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rounds", [near_dedup.ROUNDS, 3])
def test_near_components_are_exact(docs_of, near_rows, rounds):
    out = near_dedup.near_components(docs_of(near_rows), k=3, percent=85, bands=32, block=16, rounds=rounds).collect()
    want = brute(near_rows, 3, 85)
    assert len(out) == len(near_rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    sizes = {}
    for r in out:
        sizes.setdefault(r.component_id, set()).add(r.doc_id)
    assert max(map(len, sizes.values())) > 50


def test_near_components_of_nothing(docs_of):
    assert near_dedup.near_components(docs_of([])).count() == 0
    out = near_dedup.near_components(docs_of([(1, None), (2, "one text")])).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 1, True), (2, 1, 2, True)]


def test_likelihood_finds_the_similarity():
    rng = np.random.default_rng(3)
    m = 256
    for j in (0.3, 0.6, 0.85, 0.95):
        got = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            extra = int(400 * (1 - j) / j / 2)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, extra, dtype=np.uint64)]) for _ in range(2))
            r = near_dedup.registers([a, b], m)
            got.append(near_dedup.likeliest(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), m, np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(got) - j) < 0.02 and np.std(got) < 0.045


def test_estimates_lose_less_than_bands():
    from math import erfc, sqrt

    assert erfc(near_dedup.DEVIATIONS / sqrt(2)) / 2 < 1e-5  # what the bands lose at the threshold


def test_registers_merge():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    r = near_dedup.registers([a, b, np.union1d(a, b)], 128)
    assert (np.maximum(r[0], r[1]) == r[2]).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(100, 160)] + [(160, 159)] + [(7, 7)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {i: 100 for i in [500, *range(100, 161)]}


def brute_spans(rows, run, long, least):
    """All runs in order of (doc, sentence); stretches of sentences in later ones."""
    docs = {i: t for i, t in rows if i is not None and t}
    cut = {}
    for i, t in docs.items():
        out, at = [], 0
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            w = m.group()
            nl = re.search(r"[\n\r]", t[at : m.start()]) if out else None
            if not out or nl or out[-1][-1][-1] in ".!?":
                out.append([])
            out[-1].append(w.translate({c: c + 32 for c in range(65, 91)}))
            at = m.end()
        cut[i] = out
    first, later = {}, {}
    for i in sorted(cut):
        own = cut[i]
        spans = [(a, run) for a in range(len(own) - run + 1)] + [(a, 1) for a in range(len(own)) if len(own[a]) >= long]
        for a, n in sorted(spans):
            key = tuple(w for s in own[a : a + n] for w in s)
            if first.setdefault(key, (i, a)) != (i, a):
                later.setdefault(i, set()).update(range(a, a + n))
    out = set()
    for i, on in later.items():
        for a in sorted(on):
            if a - 1 not in on:
                b = a
                while b in on:
                    b += 1
                n = sum(map(len, cut[i][a:b]))
                if n >= least:
                    out.add((i, a, b - a, n))
    return out


def sentence(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n)) + rng.choice(".!?")


@pytest.fixture(scope="module")
def span_rows(odd_rows):
    rng = random.Random(2)
    passages = [" ".join(sentence(rng, rng.randrange(4, 30)) for _ in range(4)) + " " + sentence(rng, 60) for _ in range(6)]
    rows = list(odd_rows)
    for i in range(100, 220):
        parts = [sentence(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 9))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(300, rows[-1][1]), (301, "No. No. No. No. No.")]


def test_spans_match_brute_force(docs_of, span_rows):
    out = span_dedup.repeated(docs_of(span_rows)).collect()
    assert {(r.doc_id, r.first_sentence, r.n_sentences, r.n_words) for r in out} == brute_spans(span_rows, span_dedup.RUN, span_dedup.LONG, span_dedup.LEAST)
    assert all(r.first_doc_id <= r.doc_id for r in out) and len(out) > 20


def test_two_shared_sentences_go(docs_of):
    both = "The quick brown fox jumps over the lazy old dog. It then sleeps under a tall green tree until noon."
    out = span_dedup.repeated(docs_of([(1, f"First words. {both} More here."), (2, f"Other opening. {both} Another end."), (3, "Yes. No. Other text."), (4, "Yes. No. Still other.")])).collect()
    assert [(r.doc_id, r.first_sentence, r.n_sentences, r.n_words, r.first_doc_id) for r in out] == [(2, 1, 2, 20, 1)]


def test_cutting_leaves_one_copy(docs_of, span_rows):
    docs = docs_of(span_rows)
    spans = span_dedup.repeated(docs)
    out = span_dedup.without_repeats(docs, spans)
    assert out.count() == len(span_rows)
    again = span_dedup.repeated(out.where("doc_id >= 100"))
    assert again.count() == 0
    touched = {r.doc_id for r in spans.collect()}
    text = dict(span_rows)
    assert all(r.text == text[r.doc_id] for r in out.collect() if r.doc_id not in touched)


def test_windows_within_sentences_are_found(docs_of):
    """Passages that neither begin nor end at a sentence's end, against every window of 50 words."""
    rng = random.Random(12)
    some = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    docs, shared = {}, some(90)
    for i in range(40):
        part = shared[rng.randrange(45) :][: rng.randrange(40, 90)]
        if i % 5 == 0:
            part = part[:20] + [f"edit{i}."] + part[21:]
        docs[i] = some(rng.randrange(30)) + part + some(rng.randrange(30)) + (part if i % 7 == 0 else [])
    first, on = {}, {i: set() for i in docs}
    for i, w in docs.items():
        for a in range(len(w) - span_dedup.LONG + 1):
            if first.setdefault(tuple(w[a : a + span_dedup.LONG]), (i, a)) != (i, a):
                on[i].update(range(a, a + span_dedup.LONG))
    got = {i: set() for i in docs}
    for r in span_dedup.repeated(docs_of([(i, " ".join(w)) for i, w in docs.items()])).collect():
        text = " ".join(docs[r.doc_id])
        a = len(text[: r.begin].split())
        assert text[r.begin : r.end].split() == docs[r.doc_id][a : a + r.n_words]
        got[r.doc_id].update(range(a, a + r.n_words))
    assert got == on and sum(map(bool, on.values())) > 15


def test_no_spans_in_empty_tables(docs_of):
    assert span_dedup.repeated(docs_of([])).count() == 0
    assert span_dedup.repeated(docs_of([(1, None), (2, "")])).count() == 0


def test_very_long_texts_are_hashed_whole():
    import pyarrow as pa

    from hearthspan.llm import shingles, toxicity

    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(data) > 2 * shingles.STEP
    hashes, counts, starts, ends = shingles.texts_words(pa.array([text]))
    want = shingles.word_hashes(data, np.array([0, len(data)]))
    assert counts.tolist() == [400_000] and (hashes == want[0]).all() and (starts == want[2]).all() and (ends == want[3]).all()
    letters = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(400_000))
    assert toxicity.hashed_words(pa.array([letters]))[2].tolist() == [400_000]
