from __future__ import annotations

import random

import pytest

from chronoseal.operators import chains as CH

from .conftest import rows

LINK = "artifact string, depends_on string, recorded string"
ART = "artifact string, digest string"


def plain_first(artifacts, links):
    """Breadth-first search from every artifact."""
    now = dict(artifacts)
    bad = {}
    for a, d, r in links:
        code = "artifact-missing" if d not in now else "hash-missing" if r is None else "hash-changed" if r != now[d] else None
        if code:
            bad.setdefault(a, []).append((a, d, code))
    out = []
    for start in {a for a, _, _ in links}:
        level, seen, steps = {start}, {start}, 0
        while level:
            found = [b for a in level for b in bad.get(a, [])]
            if found:
                out.append((start, steps, *min(found)))
                break
            level = {d for a, d, _ in links if a in level} - seen
            seen |= level
            steps += 1
    return sorted(out)


def test_first_breaks_equal_search(spark):
    rng = random.Random(9)
    for _ in range(3):
        names = [f"a{i:02d}" for i in range(24)]
        artifacts = [(n, f"h{n}") for n in names if rng.random() < 0.93]
        links = []
        for i, n in enumerate(names):
            for d in rng.sample(names[:i], min(i, rng.randrange(0, 3))):
                links.append((n, d, rng.choice([f"h{d}"] * 14 + [None, "old"])))
        got = rows(CH.first_breaks(spark.createDataFrame(artifacts, ART), spark.createDataFrame(links, LINK)), "artifact", "steps", "broken", "depends_on", "code")
        assert got == plain_first(artifacts, links)


def test_breaks_on_cycles_and_gates(spark):
    artifacts = spark.createDataFrame([(c, c.upper()) for c in "abcdef"], ART)
    links = spark.createDataFrame([("b", "a", "A"), ("c", "b", "B"), ("d", "e", "E"), ("e", "d", "D"), ("f", "e", "E")], LINK)
    assert rows(CH.unrooted(links)) == [("d",), ("e",), ("f",)]
    assert rows(CH.chain_findings(artifacts, links), "code", "detail") == [("chain-cycle", "d"), ("chain-cycle", "e"), ("chain-cycle", "f")]
    CH.require_chain(artifacts, links, "c")
    with pytest.raises(ValueError, match="chain-cycle"):
        CH.require_chain(artifacts, links, "f")
    with pytest.raises(ValueError, match="artifact-missing: z"):
        CH.require_chain(artifacts, links, "z")
    changed = spark.createDataFrame([("a", "new"), ("b", "B"), ("c", "C")], ART)
    with pytest.raises(ValueError, match="hash-changed: b -> a"):
        CH.require_chain(changed, links, "c")
    assert rows(CH.chain_findings(artifacts, links.limit(0)), "ok", "code") == [(True, "artifact-chain")]
