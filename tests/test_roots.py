import random

from mnemo.operators import maintain


def test_roots_of_long_chains(spark):
    r = random.Random(4)
    names = [f"e{i:04}" for i in range(300)]
    mixed = names[200:]
    r.shuffle(mixed)
    pairs = [p for chain in (names[:200], mixed) for p in zip(chain, chain[1:])]
    pairs = [p if r.random() < 0.5 else p[::-1] for p in pairs] + [("z", "z")]
    got = {tuple(x) for x in maintain.roots(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {(e, "e0000" if e < "e0200" else "e0200") for e in names} | {("z", "z")}
