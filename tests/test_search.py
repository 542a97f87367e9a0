"""The scorer, and the distributed top-n against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom.functions.similarity import name_ratio, partial_ratio, partial_token_ratio, profile, ratio, score, score_bounds, token_ratio
from cubeloom.operators.search import Best, fuzzy_top
from cubeloom.suite.catalog import FUZZY_QUERIES


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_ratio_equals_the_table_form():
    rnd = random.Random(5)
    for _ in range(300):
        a = "".join(rnd.choice("abcå ") for _ in range(rnd.randint(0, 70)))
        b = "".join(rnd.choice("abcå ") for _ in range(rnd.randint(0, 70)))
        want = 200 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100
        assert abs(ratio(a, b) - want) < 1e-9


def test_scores():
    assert ratio("this is a test", "this is a test!") > 96
    assert partial_ratio("test", "this is a test!") == 100
    assert token_ratio("b a", "a b") == 100
    assert score("abc", "abc") == 100 and score("", "abc") == 0
    assert score("fuzzy was a bear", "was a bear fuzzy") == 95
    assert score("Straf", "straf") < 100
    assert name_ratio("overtraed", "overtraedtype") > 0.7


def test_top_n_equals_brute_force(spark):
    rnd = random.Random(2)
    words = ["straffelov", "saerlov", "lov", "faerdsel", "told", "skat", "jagt", "miljo"]
    labels = [(str(i), " ".join(rnd.sample(words, rnd.randint(1, 3)))) for i in range(400)]
    df = spark.createDataFrame(labels, "code string, label string").repartition(7)
    wanted = ["straf", "lov told", "miljø", "straf"]
    got = {}
    for r in fuzzy_top(df, wanted, 6).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.code, r.label))
    for q in set(wanted):
        want = sorted(labels, key=lambda x: (-score(q, x[1]), x[1], x[0]))[:6]
        assert got[q] == want


def plain_ratio(a, b):
    return 200 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100


def plain_partial(a, b):
    """Every stretch of the longer text with at most as many letters as the shorter, at its place."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0
    ends = range(1, len(long) + len(short))
    return max(plain_ratio(short, long[max(0, e - len(short)) : min(e, len(long))]) for e in ends)


def plain_score(q, t):
    """The five ratios from their definitions, word forms spelled out."""
    if not q or not t:
        return 0
    a, b = q.split(), t.split()
    both, left, right = (" ".join(sorted(w)) for w in (set(a) & set(b), set(a) - set(b), set(b) - set(a)))
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    in_order = plain_ratio(" ".join(sorted(a)), " ".join(sorted(b)))
    in_sets = plain_ratio(with_left, with_right)
    if both:
        in_sets = 100 if not left or not right else max(in_sets, plain_ratio(both, with_left), plain_ratio(both, with_right))
    apart = max(len(q), len(t)) / min(len(q), len(t))
    if apart < 1.5:
        return max(plain_ratio(q, t), 0.95 * in_order, 0.95 * in_sets)
    weight = 0.9 if apart <= 8 else 0.6
    words = 100 if both else max(plain_partial(" ".join(sorted(a)), " ".join(sorted(b))), plain_partial(left, right))
    return max(plain_ratio(q, t), weight * plain_partial(q, t), 0.95 * weight * words)


TEXT = st.text(st.sampled_from("abcæ  \t1"), max_size=14)


@settings(max_examples=600, deadline=None)
@given(TEXT, st.lists(TEXT, min_size=1, max_size=6))
def test_scores_equal_their_definition_and_keep_their_bounds(query, texts):
    bounds = score_bounds(profile([query]), profile(texts))
    for t, bound in zip(texts, bounds, strict=True):
        assert abs(score(query, t) - plain_score(query, t)) < 1e-9
        assert score(query, t) <= bound
    assert partial_token_ratio("a b", "b c") == 100 and plain_partial("ab", "xxab") == 100


def test_few_texts_are_scored(spark):
    once = sorted({r["p_name"] for r in spark.read.parquet("/root/testdata/sf0.1/part.parquet").select("p_name").collect()})
    names = [f"{a} {b}" for a in once for b in once if a != b]  # the given names are few, so their pairs
    scored = []
    for q in [f"{q} {once[i]}" for i, q in enumerate(FUZZY_QUERIES)] + ["gren anvl smal rod"]:
        best = Best(q, 5)
        for k in range(0, len(names), 1_000):
            best.offer(names[k : k + 1_000], profile(names[k : k + 1_000]))
        want = sorted(((-score(q, t), t) for t in names))[:5]
        assert best.kept == want and best.scored < len(names) / 5
        scored.append(best.scored / len(names))
    assert sum(scored) / len(scored) < 0.1
