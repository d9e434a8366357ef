import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomdex.llm import jaccard_join as J
from loomdex.llm import shingles


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(texts):
    s = sets(texts)
    label = list(range(len(s)))
    index = defaultdict(list)
    for i, x in enumerate(s):
        common = Counter(j for k in x for j in index[k])
        for j, n in common.items():
            if 100 * n >= 75 * (len(x) + len(s[j]) - n):
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
        for k in x:
            index[k].append(i)
    return [(len(x), v) for x, v in zip(s, label)]


def corpus(rng, groups=6, copies=14):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(groups):
        text = [word() for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(copies):
            t = list(text)
            for _ in range(rng.randint(0, max(1, len(t) // 20))):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t + passage if rng.random() < 0.5 else t[: len(t) * 9 // 10]
            out.append(rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in t))
    out += [" ".join([word() for _ in range(30)] + passage) for _ in range(40)] + out[:10] + ["one two three", "One  two three", "one two", None, "", " \n"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 4, "unit_sets": 5, "block_bytes": 4000, "slice_bytes": 900}, {"unit_sets": 2}, {"rows_per_bucket": 3, "hot": 2}])
def test_classes_equal_brute_force(spark, docs, options):
    for seed in range(2):
        texts = corpus(random.Random(seed))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_sets(docs(texts).repartition(3), **options).collect()}
        want = brute(texts)
        assert len(got) == len(texts) and all(got[i] == want[i] for i in range(len(texts)))


def test_odd_rows(spark, docs, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_sets(docs(odd)).collect()}
    assert [got[i] for i in range(len(odd))] == brute(odd)
    assert J.similar_sets(docs([])).count() == 0
    twice = J.similar_sets(docs(["a b", "a b"], [3, 3])).collect()
    assert [tuple(r) for r in twice] == [(3, 1, 3), (3, 1, 3)]
    assert J.similar_sets(docs(["a b", "a b", "c"], [None, 4, None])).filter("component_id = 4").count() == 2


def test_routes_in_two_steps():
    r = J.Routes(5 * 10**10, 1000, 12)  # as many rows as 100 TB hold
    assert r.two and r.coarse == 10 and r.bits == 26 and r.shards << r.coarse >= 10**6 and r.parts << r.group_bits >= 10**6
    assert len(set(r.group_of(np.arange(10**5)).tolist())) > 5000
    one = J.Routes(250_000, 1000, 12)
    assert not one.two and one.coarse == one.bits == 8 and one.to(7, 3) == (7, 0)


def test_unit_forest():
    rng = np.random.RandomState(3)
    for _ in range(30):
        base = rng.choice(5000, 120, replace=False).astype(np.uint64)
        keys = []
        for _ in range(rng.randint(2, 25)):
            k = base[rng.rand(120) < rng.choice([0.95, 0.8])]
            keys.append(np.unique(np.concatenate([k, rng.randint(5000, 9000, rng.randint(0, 20)).astype(np.uint64)])))
        n = np.array([len(k) + int(e) for k, e in zip(keys, rng.randint(0, 3, len(keys)))])
        label = list(range(len(keys)))
        for i in range(len(keys)):
            for j in range(i):
                c = len(np.intersect1d(keys[i], keys[j]))
                if c and 175 * c >= 75 * (n[i] + n[j]):
                    a, b = sorted((label[i], label[j]))
                    label = [a if v == b else v for v in label]
        found = {int(u): int(v) for u, v in J.unit_forest(np.arange(len(keys)), n, keys)}
        assert [found.get(i, i) for i in range(len(keys))] == label
        some = np.array([c if rng.rand() < 0.6 else i + 1000 for i, c in enumerate(label)])  # classes known in part
        known = {int(u): int(v) for u, v in J.unit_forest(np.arange(len(keys)), n, keys, some)}
        assert [known.get(i, i) for i in range(len(keys))] == label


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((label[a], label[b]))
        label = {k: x if v == y else v for k, v in label.items()}
    got = {r["u"]: r["v"] for r in J.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == v for x, v in label.items())


def test_word_keys():
    text = ["Ab  cd", "", "ab cd\n", "x"]
    raw = [t.encode() for t in text]
    keys, counts = shingles.word_keys(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert counts.tolist() == [2, 0, 2, 1] and keys[0] == keys[2] and keys[1] == keys[3] and len(set(keys.tolist())) == 3
