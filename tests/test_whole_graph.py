"""Graph queries over every mention, persons included, against plain Python."""

import re

import __spark_entry__
from ledgerlake.functions import text as tx
from ledgerlake.plans import graphs
from ledgerlake.plans.views import memory

SF = "/root/testdata/sf0.001"


def plain_mentions(content):
    """{(lower name, type): name} of one text."""
    listed = {n: t for n, t in {**tx.GAZETTEER, **graphs.NAMES}.items() if re.search(rf"(?i)\b{re.escape(n)}\b", content)}
    found, claimed = {(n.lower(), t): n for n, t in listed.items()}, {n.lower() for n in listed}
    for p in re.findall(tx.PERSON, content):
        if not claimed & {p.lower(), *p.lower().split()}:
            found.setdefault((p.strip().lower(), "person"), p.strip())
    return found


def test_persons_and_their_relations(spark):
    queries = __spark_entry__.queries()
    plain = {r.id: plain_mentions(r.content) for r in memory(spark, SF).select("id", "content").collect()}
    own = {(i, name, kind) for i, found in plain.items() for (_, kind), name in found.items()}
    got = {tuple(r) for r in queries["entity_mentions_whole"](spark, SF).collect()}
    assert {x for x in got if x[2] != "organization"} == {x for x in own if x[2] != "organization"}
    assert any(x[2] == "person" for x in got)

    kinds = {}
    for i, name, kind in got:
        kinds.setdefault((i, kind), set()).add(name)
    want = {
        (i, a, p, b) for (i, kind), names in kinds.items() for s, p, o in
        (("person", "works_on", "project"), ("person", "member_of", "organization"), ("project", "uses", "technology"), ("organization", "develops", "project"))
        if kind == s for a in names for b in kinds.get((i, o), ())
    }
    assert {tuple(r) for r in queries["entity_relations_whole"](spark, SF).collect()} == want
    assert {"works_on", "member_of"} & {x[2] for x in want}
