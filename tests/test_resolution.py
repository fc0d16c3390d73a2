"""Call resolution by tier tables against a reading of the rules, call by call."""

import random

from tessera.operators import resolution as R

CALLS = "edge_id long, name string, src_qname string, src_uri string"
DEFS = "target long, name string, target_qname string, target_uri string"


def by_the_rules(call, defs, uses, imports, types):
    _, name, src_qname, src_uri = call
    fits = [d for d in defs if d[1] == name]
    scope = lambda d: sum(a == b for a, b in zip(src_qname.split("::"), d[2].split("::")))
    folder = lambda u: u.rsplit("/", 1)[0] if "/" in u else ""
    most = max((scope(d) for d in fits), default=0)
    used = max((uses.get(d[0], 0) for d in fits), default=0)
    owner = lambda d: d[2].split("::")[-2] if "::" in d[2] else None
    tiers = [
        fits,
        [d for d in fits if src_uri is not None and d[3] == src_uri],
        [d for d in fits if most > 0 and scope(d) == most],
        [d for d in fits if owner(d) is not None and owner(d) == types.get(call[0])],
        [d for d in fits if src_uri is not None and d[3] is not None and (src_uri, name, d[3]) in imports],
        [d for d in fits if src_uri is not None and d[3] is not None and folder(d[3]) == folder(src_uri)],
        [d for d in fits if used >= 2 and uses.get(d[0], 0) * 2 > used],
    ]
    for t, found in enumerate(tiers, 1):
        if len(found) == 1:
            return call[0], found[0][0], t
    return None


def test_tiers_match_the_rules(spark):
    rng = random.Random(11)
    part = lambda: rng.choice(["app", "lib", "core", "io", "Graph", "Node"])
    path = lambda: "::".join(part() for _ in range(rng.randint(0, 3)))
    uri = lambda: rng.choice([None, *(f"{d}/{f}.py" for d in ("a", "b", "a/c", "d", "e") for f in "xyzw"), "top.py"])
    names = [f"n{i}" for i in range(40)]
    defs = [(i, n, "::".join(filter(None, [path(), n])), uri()) for i, n in enumerate(rng.choice(names) for _ in range(90))]
    calls = [(1000 + i, rng.choice(names), "::".join(filter(None, [path(), "f"])), uri()) for i in range(900)]
    uses = {d[0]: rng.choice([1, 2, 5, 9]) for d in defs if rng.random() < 0.4}
    imports = {(uri(), rng.choice(names), uri()) for _ in range(900)}
    types = {c[0]: part() for c in calls if rng.random() < 0.3}
    frame = spark.createDataFrame
    found = R.resolve_named(
        frame(calls, CALLS), frame(defs, DEFS), frame(list(uses.items()), "target long, uses long"), frame(list(imports), "src_uri string, name string, target_uri string"), frame(list(types.items()), "edge_id long, type string")
    ).collect()
    want = sorted(filter(None, (by_the_rules(c, defs, uses, imports, types) for c in calls)))
    assert sorted((r.edge_id, r.target, r.tier) for r in found) == want
    assert {t for *_, t in want} == set(range(1, 8))
    assert all(r.conf_class == ("extracted" if r.tier <= 2 else "inferred") for r in found)
