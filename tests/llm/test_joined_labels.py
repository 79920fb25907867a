"""Near duplicates: later rounds look at their own links alone, each component as one node."""

import random

import numpy as np
import pytest

from ledgerspark.llm import near_duplicates


def plain(links):
    label = {}
    for a, b in links:
        low, high = sorted((label.setdefault(a, a), label.setdefault(b, b)))
        label = {n: low if x == high else x for n, x in label.items()}
    return label


@pytest.mark.parametrize("seed", range(3))
def test_labels_after_more_links_are_those_of_all_links(spark, seed):
    draw = random.Random(seed)
    known, more = ([tuple(sorted(draw.sample(range(60), 2))) for _ in range(n)] for n in (25, 20 * seed))
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    found = near_duplicates.joined_labels(near_duplicates.components(frame(known)), frame(more))
    assert sorted(map(tuple, found.collect())) == sorted(plain(known + more).items())


def test_rounds_look_at_their_own_links_alone(spark, monkeypatch):
    draw, seen, links = np.random.default_rng(6), [], []
    word = lambda: "w" + str(draw.integers(0, 10**6))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(40):
        own = [word() for _ in range(40)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1] + [word()])]
    components, verified = near_duplicates.components, near_duplicates.verified

    def counted(function, counts, result):
        def inner(*given):
            out = function(*given)
            counts.append((out if result else given[0]).count())
            return out
        return inner

    monkeypatch.setattr(near_duplicates, "PIVOTS", 2)
    monkeypatch.setattr(near_duplicates, "components", counted(components, seen, False))
    monkeypatch.setattr(near_duplicates, "verified", counted(verified, links, True))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_duplicates.classes(table, settings=near_duplicates.Settings(bands=2, rows=1)).collect()
    assert len({r.class_id for r in rows}) < len(texts) and sum(n > 0 for n in links) >= 2
    assert sum(seen) <= sum(links)
