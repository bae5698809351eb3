import math
import statistics

import pytest

from millrace.llm.mixing import mix
from millrace.llm.rank_fusion import hit_ranks, median_ranking, positions, top_items

HITS = "query_id long, retriever string, _id string, _score float, extra int"
NAN = float("nan")


def brute(hits, weights=None):
    lists = {}
    for q, r, i, s, _ in hits:
        if None not in (q, r, i, s) and not math.isnan(s):
            own = lists.setdefault(q, {}).setdefault(r, {})
            own[i] = max(s, own.get(i, s))
    out = {}
    for q, by in lists.items():
        items = {i for own in by.values() for i in own}
        for i in items:
            ranks = []
            for r, own in by.items():
                if i in own:
                    above, tied = sum(s > own[i] for s in own.values()), sum(s == own[i] for s in own.values())
                    ranks.append((above + (tied + 1) / 2, (weights or {}).get(r, 1)))
                else:
                    ranks.append((len(own) + (len(items) - len(own) + 1) / 2, (weights or {}).get(r, 1)))
            ranks.sort()
            half, seen = sum(w for _, w in ranks) / 2, 0
            median = next(x for x, w in ranks if (seen := seen + w) >= half)
            out[q, i] = (median, sum(x * w for x, w in ranks) / (half * 2))
    return out


def hits():
    import random

    rng = random.Random(1)
    out = [(q, r, f"i{rng.randrange(15)}", rng.choice([0.0, -0.0, 1.5, -3.0, NAN, None, float("inf"), rng.random()]), 1) for q in (1, 2, 3) for r in "abcd" for _ in range(12)]
    return out + out[:9] + [(None, "a", "x", 1.0, 1), (1, None, "x", 1.0, 1), (1, "a", None, 1.0, 1), (9, "a", "x", NAN, 1), (7, "o'k\\", "x", 1.0, None)]


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "o'k\\": 2.0}])
def test_median_ranking(spark, weights):
    data = hits()
    got = {(r.query_id, r._id): (r.median_rank, r.mean_rank) for r in median_ranking(spark.createDataFrame(data, HITS), weights).collect()}
    want = brute(data, weights)
    assert got.keys() == want.keys()
    for k, (median, mean) in want.items():
        assert got[k][0] == median and got[k][1] == pytest.approx(mean)


def test_positions_and_top(spark):
    ranking = median_ranking(spark.createDataFrame(hits(), HITS))
    placed = [tuple(r) for r in positions(ranking).collect()]
    for q in {p[0] for p in placed}:
        own = sorted((p for p in placed if p[0] == q), key=lambda p: p[4])
        assert [p[4] for p in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda p: (p[2], p[3], p[1]))
    assert {tuple(r) for r in top_items(ranking, 2).collect()} == {(p[0], p[1]) for p in placed if p[4] <= 2}


def test_empty_hits(spark):
    empty = spark.createDataFrame([], HITS)
    assert hit_ranks(empty).count() == 0 and positions(median_ranking(empty)).count() == 0


DOCS = "doc_id long, text string, source string, tokens int"
TARGETS = "source_name string, target_share double, max_repeats int"


def test_mix(spark):
    docs = [(k, "word " * (k % 7), [" Big", "big", "small ", "tiny", None, "other"][k % 6], 0) for k in range(600)]
    docs += [(1000, None, "big", 0), (1001, "", "tiny", 0)]
    size = {"big": 0, "small": 0, "tiny": 0}
    for _, t, s, _ in docs:
        if s and s.strip().lower() in size:
            size[s.strip().lower()] += len((t or "").split())
    targets = [("big", 0.3, 2), ("small", 0.4, 3), ("tiny", 0.3, 1), ("none", 0.0, 2), ("void", None, None)]
    drawn, report = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), "words")
    got, rep = [tuple(r) for r in drawn.collect()], {r.source_name: r for r in report.collect()}
    total = sum(size.values())
    assert set(rep) == {t[0] for t in targets}
    for name, share, cap in targets[:3]:
        own = [g for g in got if g[1] == name]
        assert rep[name].tokens == size[name] and rep[name].reachable == (share * total <= cap * size[name])
        budget = min(share * total, cap * size[name])
        spent = sum(t * c for _, _, t, c in own)
        assert budget - 7 < spent <= budget and rep[name].drawn == spent
        assert all(1 <= c <= cap for *_, c in own) and max(c for *_, c in own) - min(c for *_, c in own) <= 1
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    assert len({g[0] for g in got}) == len(got)


def test_mix_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    drawn, report = mix(docs, targets, "words")
    assert drawn.count() == 0 and report.first().drawn == 0 and statistics.fmean([report.first().actual_share]) == 0
