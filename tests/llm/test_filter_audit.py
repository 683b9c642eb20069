"""Filter interaction audit: every order by simulation, with the odd inputs."""

import re
from itertools import permutations

import pytest

from fleetlens.llm import filter_audit as audit

LABELS = "doc_id long, quality int, toxic int"


def simulate(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    docs = []
    for d, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first.get(t, d) < d}
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        removed_by = dict.fromkeys(audit.FILTERS, 0)
        for order in map("".join, permutations(audit.FILTERS)):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[1]]
                redundant = sum(x in d[1] for d in gone)
                left = [d for d in left if x not in d[1]]
                gone += removed
                removed_by[x] += len(removed)
                alone = sum(d[1] == {x} for d in docs if d[0] == part)
                out[part, order, step] = [len(left), len(removed), redundant, alone, sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def report(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n long, part string")
    marks = spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' AS part")
    got = audit.order_report(audit.failure_combinations(docs, marks)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_every_order_equals_a_simulation(spark):
    clean = " ".join(f"w{k}" for k in range(250))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, clean, None), (4, clean, ""), (5, clean, "de"), (5, clean, "de"), (5, "other " * 300, "de"), (None, clean, "de"), (None, "x", None), (None, "x", None),
        (6, " " + clean + " #", "fr"), (7, "SHOUT " * 300, "fr"), (8, "a\x0bb\x1cc " * 100, "fr"), (9, "漢字 🙂 " * 120, "fr"), (10, "a b " * 200_000, "en"), (11, "a b " * 200_000, "en"),
        *((100 + k, "hot copy " * 30, "en") for k in range(50)), (12, "X" * 3 + "y" * 97, "es"), (13, "X" * 4 + "y" * 96, "es"), (14, clean + " \n\t ", "es"), (0, clean + " \n\t ", "en"),
    ]
    labels = [(3, 1, 0), (4, 0, 1), (5, 1, 1), (5, 0, 0), (7, 1, None), (8, None, 1), (None, 1, 1), (105, 1, 1), (100, 1, 1), (999, 1, 1)]
    assert report(spark, rows, labels) == simulate(rows, labels)


def test_empty_tables(spark):
    assert report(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "a", "en")]
    assert report(spark, rows, []) == simulate(rows, []) and len(simulate(rows, [])) == 600


@pytest.mark.parametrize("hash_", ["xxhash64(text)", "length(text) % 2", "0"])
def test_only_later_copies_fail_e(spark, hash_):
    """Also where a hash stands for several texts."""
    rows = [(3, "t"), (1, "t"), (2, "t"), (2, "u"), (2, "u"), (None, "t"), (9, "vv"), (8, "vv"), (7, "ww"), (6, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", f"CAST({hash_} AS LONG) AS hash", "'' AS part")
    assert sorted(r.doc_id for r in audit.later_copies(docs).collect()) == [2, 3, 6, 9]
