"""Items with other names, inserted words and parts of items."""

import random

import pyarrow as pa

from gleaner.llm import decontam

BASKET = "Alice has 12 apples in her basket. Alice gives 5 apples to her friend. Bob then eats 2 of the apples. How many apples does Alice have left?"


def hits(item, *texts):
    return {d for d, _, _ in decontam.Index([1], [item]).search(pa.array(texts, pa.string()))}


def words(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}x" for i in range(n)]


def test_names_that_open_sentences():
    other = BASKET.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "31").replace("5", "7").replace("2 of", "4 of")
    mixed = "Carol".join(other.split("Carol")[:-1]) + "Erin" + other.split("Carol")[-1]
    assert hits(BASKET, other, "Well: " + other, mixed) == {0, 1}


def test_runs_of_names_are_one_name():
    assert hits(BASKET, BASKET.replace("Alice", "Mary Ann"), BASKET.replace("Bob", "Mary Ann Lee")) == {0, 1}


def test_spans_at_near_offsets_add_up():
    item = words(37, 1)
    assert hits(" ".join(item), " ".join([*item[:13], "really", *item[13:25], "truly", *item[25:]])) == {0}
    long = words(200, 2)
    assert hits(" ".join(long), " ".join(["so", *long[60:120], "then"]), " ".join(["so", *long[60:80], "then"])) == {0}


def test_an_inconsistent_slot_costs_its_span_only():
    item = words(20, 3) + ["Alice", "met"] + words(20, 4) + ["Alice"]
    other = list(item)
    other[-1] = "Carol"
    assert hits(" ".join(item), " ".join(other)) == {0}
    assert not hits(BASKET, "Carol has 13 apples in her basket. Erin gives 13 apples to her friend. Carol then eats 13 of the apples. How many apples does Dan have left?")
