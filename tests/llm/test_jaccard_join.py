import random

import pytest

from emberlog.llm.components import components
from emberlog.llm.jaccard_join import jaccard_components, one_of_each, prefix_length
from plain_text import linked_components


def near_copies(seed, families=8, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(12)]
    texts, k = {}, 0
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, words))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += passage
            texts[k] = " ".join(w.upper() if rng.random() < 0.1 else w for w in own)
            k += 1
    return texts


@pytest.mark.parametrize("seed, size, num, den", [(1, 3, 9, 10), (2, 5, 8, 10), (3, 1, 1, 2)])
def test_against_all_pairs(docs_of, monkeypatch, seed, size, num, den):
    import emberlog.llm.jaccard_join as j

    monkeypatch.setattr(j, "CHUNK", 4)  # so that lists are cut into chunks
    texts = near_copies(seed)
    found, sizes = linked_components(texts, size, num, den)
    got = jaccard_components(docs_of([(i, t, "en", "a") for i, t in texts.items()]), size, num, den).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == found
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes


def test_chains_reach_their_smallest_member(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_awkward_rows(awkward):
    got = jaccard_components(awkward, 3, 9, 10).collect()
    assert len(got) == awkward.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert by[4] == by[5] == by[6] == [(1, 4)]
    assert by[7][0][1] == by[8][0][1] == 7
    assert by[9] == [(10, 9), (10, 9)]
    assert set(by[None]) == {(0, None), (10, 9)}
    assert by[11] == [(1, 11), (1, 11)]


def test_one_document_of_each_group_stays(awkward, no_docs):
    kept = one_of_each(awkward, 3, 9, 10)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 7, 9, 9, 10, 11, 11, None, None]
    assert one_of_each(no_docs).count() == 0
    assert jaccard_components(no_docs).count() == 0


def test_prefixes_meet_if_sets_link():
    for n in range(1, 60):
        for m in range(n, 60):
            for both in range(n + 1):
                if 10 * both >= 8 * (n + m - both):
                    # The smaller overlap that prefixes leave uncovered is below what a link needs.
                    assert n - prefix_length(n, 8, 10) < both and m - prefix_length(m, 8, 10) < both
