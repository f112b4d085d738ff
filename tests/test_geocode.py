import random
from collections import Counter

from demarca.operators.geocode import geocode_by_neighbors

WORDS = ["CENTRO", "NORTE", "SUR", "EL", "DEL", "VALLE", "SAN", "JUAN"]


def brute(target, registry):
    _, state, cp, name = target
    cand = [r for r in registry if r[0] == state and r[1] == cp] if state and cp else []
    if not cand:
        return None, None, "none"
    t = (name or "").upper().split()
    hits = []
    for _, _, n, mun, tract in cand:
        c = (n or "").upper().split()
        if t and c:
            short, long = (t, c) if len(t) <= len(c) else (c, t)
            if set(short) <= set(long):
                hits.append((mun, tract))
    if hits:
        return (*min(hits), "cp_colonia")
    muns = Counter(r[3] for r in cand)
    mun = min(muns, key=lambda m: (-muns[m], m))
    tracts = Counter(r[4] for r in cand if r[3] == mun)
    return mun, min(tracts, key=lambda m: (-tracts[m], m)), "cp_modal"


def test_equals_brute_force(spark):
    r = random.Random(2)

    def name():
        return " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 5)))

    # a third of the rows share one postcode
    registry = [
        ("09", "01000" if i % 3 == 0 else f"0100{r.randrange(5)}", name(), f"0900{r.randrange(3)}", f"T{r.randrange(4)}")
        for i in range(240)
    ]
    targets = [
        (i, r.choice(["09", "10", ""]), r.choice(["01000", "01001", "01002", "", "99999"]), r.choice([name(), None]))
        for i in range(150)
    ]
    reg = spark.createDataFrame(registry, "state string, postcode string, name string, mun string, tract string")
    tar = spark.createDataFrame(targets, "id long, state string, postcode string, colonia string")
    got = {
        x.id: (x.cve_mun, x.cvegeo, x.geocode_method)
        for x in geocode_by_neighbors(tar, reg, "colonia", "name", "mun", "tract").collect()
    }
    assert len(got) == 150
    for t in targets:
        assert got[t[0]] == brute(t, registry), t


def test_part_of_a_word_is_no_match(spark):
    reg = spark.createDataFrame(
        [("09", "1", "DEL VALLE", "A", "a"), ("09", "1", "OTRA", "B", "b"), ("09", "1", "OTRA", "B", "b")],
        "state string, postcode string, name string, mun string, tract string",
    )
    tar = spark.createDataFrame([(1, "09", "1", "El Valle"), (2, "09", "1", "Del Valle Norte")],
                                "id long, state string, postcode string, colonia string")
    got = {x.id: x.geocode_method for x in geocode_by_neighbors(tar, reg, "colonia", "name", "mun", "tract").collect()}
    assert got == {1: "cp_modal", 2: "cp_colonia"}
