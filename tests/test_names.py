"""Containment of names and mentions against nested loops."""

import random

import pytest

from folium.operators import mining


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_contained_against_nested_loop(spark, most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 9)))
    needles, hays = ({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(80)} for _ in range(2))
    n, h = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in hays], "hay string")
    assert {r.needle for r in mining.contained(n, h, "needle", gram=3, most=most).collect()} == {x for x in needles if any(x in y for y in hays)}
    assert {r.hay for r in mining.contained(n, h, "hay", gram=3, most=most).collect()} == {y for y in hays if any(x in y for x in needles)}
    assert mining.contained(n.limit(0), h, "needle").count() == mining.contained(n, h.limit(0), "hay").count() == 0


def test_known_entities_on_awkward_names(spark):
    cands = spark.createDataFrame([("ana maria", 1), ("ana maria", 2), ("", 3), (None, 4), ("ria da", 5), ("zé", 6), ("joao", 7)], "key string, p int")
    profiles = spark.createDataFrame([("Maria da Silva",), ("ANA",), (None,), ("",), ("João",)], "name string")
    got = {(r.key, r.p): r.known for r in mining.known_entities(cands, profiles).collect()}
    assert got == {("ana maria", 1): True, ("ana maria", 2): True, ("", 3): False, (None, 4): False, ("ria da", 5): True, ("zé", 6): False, ("joao", 7): True}
    assert not any(r.known for r in mining.known_entities(cands, profiles.limit(0)).collect())


@pytest.mark.parametrize("at_once", [1, 3, 50_000])
def test_mentions_in_shards(spark, at_once):
    rng = random.Random(at_once)
    names = [" ".join(rng.choices(["Ana", "Rui", "de", "Sá", "Lo"], k=rng.randint(1, 4))) for _ in range(12)]
    texts = [(i, " ".join(rng.choices(["ana", "RUI", "de", "sá", "lo", "x"], k=8)) if i % 7 else None) for i in range(40)]
    held = lambda needle: [i for i, t in texts if t is not None and needle in t.lower()]
    said = set()
    for name in names:
        full = held(name.lower())
        said |= {(name, i, not full) for i in full or held(" ".join(name.lower().split(" ")[-2:]))}
    chunks = spark.createDataFrame([("t", i, t) for i, t in texts], "title string, ordinal int, text string").repartition(5)
    got = mining.mentions(spark.createDataFrame([(n,) for n in names], "name string"), chunks, at_once).collect()
    assert {(r.name, r.ordinal, r.by_tail) for r in got} == said and len(got) == len(said)
