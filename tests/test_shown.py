"""Reader layout and trace markup against what they should look like."""

import json

from pyspark.sql import functions as F

from docquarry.operators import shown


def test_reader_layout(spark):
    pages = spark.createDataFrame(
        [("q", 0, False, 3, "search", True), ("q", 1, False, 1, "search", False), ("q", 2, False, 9, "question_page_scope", True), ("q", 3, True, 2, "search", True), ("q", 4, False, None, None, True), ("q", 5, False, None, None, True), ("q", 6, False, None, None, True), ("p", 0, None, 1, "x", None)],
        "question string, page_index int, pruned boolean, step int, source string, has_image boolean",
    )
    nodes = spark.createDataFrame(
        [("q", 0, "b", "Active", True, False), ("q", 0, "c", "Opened", False, True), ("q", 0, "a", "Pruned", True, True), ("q", 1, "d", "Opened", False, True), ("q", 3, "e", "Opened", True, True), ("q", 4, "z", "Opened", True, True), ("q", 5, "y", "Active", False, False), ("q", 6, "x", "Inactive", True, True)],
        "question string, page_index int, id string, state string, has_image boolean, can_crop boolean",
    )
    got = [tuple(r)[1:] for r in shown.reader_layout(pages, nodes, "question").where("question = 'q'").orderBy("place", "position").collect()]
    assert got == [
        (1, 0, 2, None, "page", "page_image_1", 0),
        (2, 0, 1, None, None, None, None),  # no image, so no crop either
        (2, 1, 1, "d", None, None, None),
        (3, 0, 0, None, "page", "page_image_2", 1),
        (3, 1, 0, "c", "opened_node_crop", "node_image_3", 2),
        (3, 2, 0, "b", "opened_node_image", "node_image_4", 3),
        (4, 0, 5, None, "page", "page_image_5", 4),  # an active node comes before an opened one
        (4, 1, 5, "y", None, None, None),
        (5, 0, 4, None, "page", "page_image_6", 5),
        (5, 1, 4, "z", "opened_node_image", "node_image_7", 6),
    ]
    plain = shown.reader_layout(pages, nodes, "question", page_images=False, crops=False).where("kind is not null").orderBy("place", "position").collect()
    assert [(r.id, r.ref) for r in plain] == [("b", "node_image_1"), ("z", "node_image_2")]
    assert shown.reader_layout(pages.limit(0), nodes, "question").count() == 0


STEPS = [
    ({"iteration": 1, "action": "ActivatePage", "ok": True, "payload": {"page_index": 2, "source": "a<b", "previous_state": "Inactive"}}, '    <step iteration="1" action="ActivatePage" ok="True" page_index="2" page_node="page:2" source="a&lt;b" previous_state="Inactive"/>'),
    ({"iteration": 1, "action": "OpenNode", "ok": False, "payload": {"node_id": "n1"}, "selection": {"candidate_index": 4, "candidate_id": "c"}, "message": "no \"way\""}, '    <step iteration="1" action="OpenNode" ok="False" target="n1" selection="4" candidate="c">\n      <message>no &quot;way&quot;</message>\n    </step>'),
    ({"action": "PruneNode", "payload": {"node_id": "n2", "previous_state": "Active", "reason": "x" * 300}}, '    <step action="PruneNode" target="n2" previous_state="Active">\n      <reason>' + "x" * 240 + "...</reason>\n    </step>"),
    ({"action": "SearchEvidence", "payload": {"query": "q & a"}}, '    <step action="SearchEvidence" query="q &amp; a"/>'),
    (
        {"action": "SearchEvidenceRetrieval", "query": "q", "activated_pages": [3], "retrieved_pages": [{"page_index": 3, "score": "0.5"}, {"page_index": 4}]},
        '    <step action="SearchEvidenceRetrieval" query="q">\n      <retrieved_pages>\n        <page page_index="3" page_node="page:3" score="0.5" activated="True"/>\n        <page page_index="4" page_node="page:4" activated="False"/>\n      </retrieved_pages>\n'
        '      <activated_page_nodes>\n        <page page_index="3" page_node="page:3"/>\n      </activated_page_nodes>\n    </step>',
    ),
    (
        {"iteration": 2, "action": "EvaluatorDecision", "decision": {"stop": False, "selected_actions": [{"candidate_index": 1, "utility": "high"}, {"candidate_index": 9}], "open_requests": [{"node_id": "n3"}], "prune_requests": [{"node_id": "n4", "reason": "r"}], "search_query": "find"}, "candidate_index_map": {"1": "cand"}},
        '    <step iteration="2" action="EvaluatorDecision" stop="False" selected_actions="2" open_requests="1" prune_requests="1" query="find">\n      <selected_actions>\n        <action index="1" candidate="cand" utility="high"/>\n        <action index="9"/>\n      </selected_actions>\n'
        '      <open_requests>\n        <node id="n3"/>\n      </open_requests>\n      <search_request>find</search_request>\n      <prune_requests>\n        <node id="n4"><reason>r</reason></node>\n      </prune_requests>\n    </step>',
    ),
    ({"action": "EvaluatorDecision", "decision": {"stop": True}}, '    <step action="EvaluatorDecision" stop="True" selected_actions="0" open_requests="0" prune_requests="0"/>'),
    ({"action": "TruncatedSelectedActions", "original_count": 5, "executed_count": 3}, '    <step action="TruncatedSelectedActions" original_count="5" executed_count="3"/>'),
    ({"action": "InvalidCandidate", "candidate_index": 7}, '    <step action="InvalidCandidate" candidate_index="7"/>'),
    ({"action": "SelectedActionBudgetReached", "executed_total": 3, "limit": 3, "message": "m"}, '    <step action="SelectedActionBudgetReached" executed_total="3" limit="3">\n      <message>m</message>\n    </step>'),
    ({"action": "Other", "iteration": 0}, '    <step iteration="0" action="Other"/>'),
]


def test_steps_of_every_kind(spark):
    rows = [("t", i, json.dumps(item)) for i, (item, _) in enumerate(STEPS)] + [("u", i, json.dumps({"action": f"a{i}"})) for i in range(40)] + [("v", 0, "{broken")]
    df = spark.createDataFrame(rows, "t string, n int, item string").repartition(3)
    node = lambda i: F.concat(F.lit("page:"), i.cast("string"))
    got = {r.t: r.xml for r in shown.recent_steps(df, "t", ["n"], "item", node).collect()}
    assert got["t"].split("\n    <step")[1:] == ("\n" + "\n".join(x for _, x in STEPS) + "\n  </recent_trace>").split("\n    <step")[1:]
    assert got["u"].count("<step") == 25 and "a39" in got["u"] and '"a14"' not in got["u"]
    assert got["v"] == '  <recent_trace>\n    <step action=""/>\n  </recent_trace>'
