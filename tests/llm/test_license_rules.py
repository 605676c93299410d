"""Each alternative of each licence rule is met by a text made for it, through the keyword prefilter."""

import re
from re import _parser as sre

import pytest


def examples(items) -> list[str]:
    """Texts of a parsed pattern: every branch once, optional parts with and without."""
    out = [""]
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "ANY":
            more = ["x"]
        elif name == "IN":
            first, arg = value[0]
            more = [chr(v) for o, v in value if str(o) == "LITERAL"] or [chr(arg[0]) if str(first) == "RANGE" else "w"]
        elif name == "BRANCH":
            more = [t for branch in value[1] for t in examples(branch)]
        elif name == "SUBPATTERN":
            more = examples(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, inner = value
            once = examples(inner)
            more = [t * low for t in once[:1]] + [t * max(1, low) for t in once]
        else:
            raise AssertionError(name)
        # one text for each choice at this place, not each combination
        out = [out[0] + m for m in more] + [o + more[0] for o in out[1:]]
    return sorted(set(out))


def test_every_alternative_has_its_keyword():
    from urbanlattice.llm import licenses as L

    for r in L.default_rules():
        texts = [t for t in examples(sre.parse(r.pattern)) if re.fullmatch(r.pattern, t) and "  " not in t]
        assert texts, r
        for t in texts:
            assert f" {r.keyword}" in f" {t}" or r.keyword in t, (r.name, t)


def test_every_alternative_is_found(spark):
    from urbanlattice.llm import licenses as L

    rules = L.default_rules()
    made = sorted({(r.label, t) for r in rules for t in examples(sre.parse(r.pattern)) if re.fullmatch(r.pattern, t) and "  " not in t})
    rows = {r["doc_id"]: r for r in L.digest(L.scan(spark.createDataFrame([(i, f"see: {t}.") for i, (_, t) in enumerate(made)], "doc_id bigint, text string"))).collect()}
    by_label: dict[str, int] = {}
    for i, (label, text) in enumerate(made):
        assert rows[i]["labels"], text  # its own label, or that of a rule of higher priority that holds it
        by_label[label] = by_label.get(label, 0) + (label in rows[i]["labels"].split(","))
    assert not [label for label, n in by_label.items() if not n]


def test_count_of_hand_written_rules():
    from urbanlattice.llm import licenses as L

    lines = [x.split(" | ") for x in L.CLAUSES.splitlines()]
    assert len(lines) > 200 and len({x[0] for x in lines}) == len(lines) and len({x[3] for x in lines}) == len(lines)


@pytest.mark.parametrize("text", ["This code is licensed under the Expat license.", "Licensed under the Expat licence", "(Expat license)"])
def test_expat(spark, text):
    from urbanlattice.llm import licenses as L

    row = L.digest(L.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    assert row["labels"] == "mit"
