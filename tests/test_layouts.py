"""Layouts of flows and sequences."""

from corpuslens.operators import diagrams as D

FLOW = '{"type": "flow", "nodes": [{"id": "s", "text": "go", "type": "start"}, {"id": "a", "text": "one\\\\ntwo"}, {"id": "q", "text": "ok?", "type": "decision"}, {"id": "e", "text": "done", "type": "end"}], "edges": [{"from": "s", "to": "a"}, {"from": "q", "to": "s", "label": "no"}, {"from": "q", "to": "e", "label": "yes"}, {"from": "s", "to": "e"}, {"from": "a", "to": "zz"}]}'


def test_flow_of_json(spark):
    configs = spark.createDataFrame([(1, FLOW), (2, '{"type": "sequence"}'), (3, None)], "diagram_id bigint, config string")
    rows = D.flow_layout(*D.flow_parts(configs)).collect()
    nodes = {r.label: r for r in rows if r.part == "node"}
    assert {k: (r.shape, r.x, r.y, r.width, r.height) for k, r in nodes.items()} == {"go": ("rounded", 380, 90, 320, 52), "one\\ntwo": ("box", 380, 200, 320, 74), "ok?": ("diamond", 380, 310, 300, 52), "done": ("rounded", 380, 420, 320, 52)}
    edges = {r.seq: r for r in rows if r.part == "edge"}
    assert (edges[0].shape, edges[0].y, edges[0].to_y, edges[0].label) == ("straight", 122, 168, None)
    assert (edges[1].shape, edges[1].x, edges[1].bend_x, edges[1].y, edges[1].to_y, edges[1].label_x, edges[1].label_y) == ("side", 540, 650, 310, 90, 638, 310)
    assert (edges[2].shape, edges[2].label_x, edges[2].label_y) == ("straight", 406, 365)
    assert edges[3].bend_x == 604  # the second track
    assert [(r.seq, r.label) for r in rows if r.part == "unknown"] == [(4, "zz")]


def test_repeated_nodes_and_empty_flows(spark):
    nodes = spark.createDataFrame([(1, 0, "a", "x", None), (1, 1, "b", None, "end"), (1, 2, "a", "y", "start")], "diagram_id bigint, seq int, id string, text string, type string")
    edges = spark.createDataFrame([(1, 0, "a", "b", None), (1, 1, None, "b", None)], "diagram_id bigint, seq int, src string, dst string, label string")
    rows = D.flow_layout(nodes, edges).collect()
    assert sorted((r.label, r.y) for r in rows if r.part == "node") == [("", 200), ("y", 310)]
    assert [(r.y, r.to_y) for r in rows if r.part == "edge"] == [(342, 168)] and len([r for r in rows if r.part == "unknown"]) == 1
    assert D.flow_layout(nodes.limit(0), edges.limit(0)).count() == 0


def test_sequences_of_changing_shape(spark):
    configs = [
        (1, '{"type": "sequence", "actors": ["A", "B"], "messages": [{"from": 0, "to": 1, "label": "SYN", "note": "n"}, {"from": "B", "to": 0, "label": "ACK"}, {"from": 0, "to": 2}, {"from": -1, "to": -2, "label": "x"}]}'),
        (2, '{"type": "sequence", "actors": []}'),
        (3, "{broken"),
        (4, '{"type": "pie"}'),
        (5, FLOW),
        (6, None),
        (7, '{"type": "sequence", "actors": ["only"], "width": 500}'),
    ]
    rows = D.sequence_layout(spark.createDataFrame(configs, "diagram_id bigint, config string")).collect()
    part = lambda d, p: sorted([r for r in rows if r.diagram_id == d and r.part == p], key=lambda r: r.seq)
    assert [(r.label, r.x, r.y) for r in part(1, "actor")] == [("A", 270, 50), ("B", 730, 50)]
    said = part(1, "message")
    assert [(r.seq, r.shape, r.x, r.to_x, r.y) for r in said] == [(1, "right", 270, 730, 130), (2, "left", 730, 270, 225), (4, "left", 730, 270, 415)]
    assert (said[0].label, said[0].label_x, said[0].label_y, said[0].note_x, said[0].note_y) == ("SYN\nn", 500, 114, 540, 148) and said[1].note_x is None
    assert [(r.seq, r.label) for r in part(1, "unknown")] == [(3, "2")] and part(1, "frame")[0].height == 550
    assert {r.diagram_id: r.part for r in rows if r.diagram_id in (2, 3, 4, 6)} == {2: "invalid", 3: "invalid", 4: "unsupported", 6: "invalid"}
    assert not [r for r in rows if r.diagram_id == 5] and part(7, "actor")[0].x == 250
