import json

import pytest

from graphloom.functions import schemas


def labels(s):
    return set(s.nodes)


def test_json_forms():
    entities = [{"label": "Harbour", "properties": {"depth": "double", "opened": "date"}}]
    relations = [{"label": "FERRY_TO", "subj_label": "Harbour", "obj_label": "Harbour", "properties": {"minutes": "long"}}]
    s = schemas.from_entity_lists({"entities": entities, "relations": relations})
    assert s.nodes == {"Harbour": {"depth": "FLOAT", "opened": "DATE"}} and s.relations == {("Harbour", "FERRY_TO", "Harbour"): {"minutes": "INTEGER"}}
    body = {"node_props": {"Ship": [{"property": "draught", "datatype": "FLOAT"}]}, "rel_props": {"MOORS": [{"property": "since", "datatype": "DATE_TIME"}]}, "relationships": [{"start": "Ship", "type": "MOORS", "end": "Quay"}]}
    s = schemas.from_property_tables({"north": body, "south": {}}, "north")
    assert labels(s) == {"Ship", "Quay"} and s.relations[("Ship", "MOORS", "Quay")] == {"since": "DATE_TIME"}
    assert schemas.from_property_tables({"only": body}, "other").relations == s.relations


SECTIONED = """Node properties:
- **Ship**
  - `draught`: FLOAT
  - `flag`: STRING
- **Quay**
Relationship properties:
- **MOORS**
  - `fee`: INTEGER
The relationships:
(:Ship)-[:MOORS]->(:Quay)
"""
PROSE = """Relevant node labels and what they hold:
Ship {draught: FLOAT, `home port`: STRING}
Quay {}
'Crane',

Relevant relationships are:
{'start': Ship, 'type': MOORS, 'end': Quay }
{start: 'Crane', type: 'STANDS_ON', end: 'Quay'}
"""
PRINTED = """[<Record nodes=[<Node labels=frozenset({'Ship'}) properties={'x': 1}>, <Node labels=frozenset({'Quay', 'Wharf'})>]
 relationships=[<Relationship element_id='5' nodes=(<Node labels=frozenset({'Ship'})>, <Node labels=frozenset({'Quay', 'Wharf'})>) type='MOORS' properties={}>]>]"""
INSPECTED = {"Ship": {"type": "node", "properties": {"flag": {"type": "STRING"}}, "relationships": {"TOWS": {"direction": "in", "labels": ["Tug"]}}}, "Tug": {"type": "node"}, "TOWS": {"type": "relationship", "properties": {"rope": {"type": "FLOAT"}}}}


@pytest.mark.parametrize(
    "text, nodes, relations",
    [
        (SECTIONED, {"Ship": {"draught": "FLOAT", "flag": "STRING"}, "Quay": {}}, {("Ship", "MOORS", "Quay"): {"fee": "INTEGER"}}),
        ("(:Quay)<-[:MOORS]-(:Ship)-[:FLIES]->(:Flag)", {"Ship": {}, "Quay": {}, "Flag": {}}, {("Ship", "MOORS", "Quay"): {}, ("Ship", "FLIES", "Flag"): {}}),
        (PROSE, {"Ship": {"draught": "FLOAT", "home port": "STRING"}, "Quay": {}, "Crane": {}}, {("Ship", "MOORS", "Quay"): {}, ("Crane", "STANDS_ON", "Quay"): {}}),
        ("The node properties are the following:\n\nBuoy\n`Light House`\n\nSailor", {"Buoy": {}, "Light House": {}}, {}),
        (PRINTED, {"Ship": {}, "Quay": {}}, {("Ship", "MOORS", "Quay"): {}}),
        (json.dumps(INSPECTED), {"Ship": {"flag": "STRING"}, "Tug": {}}, {("Tug", "TOWS", "Ship"): {"rope": "FLOAT"}}),
        ("no schema at all", {}, {}), ("", {}, {}),
    ],
)
def test_text_forms(text, nodes, relations):
    s = schemas.from_text(text)
    assert (s.nodes, s.relations) == (nodes, relations)


def test_canonical_order_merging_and_errors(spark):
    a = schemas.normalize("text", "g", "(:B)-[:R]->(:A)")
    b = schemas.normalize("text", "g", "(:A)<-[:R]-(:B)")
    assert a == b and [n["label"] for n in json.loads(a[1])["nodes"]] == ["A", "B"]
    assert [u for u, _ in schemas.units_of(json.loads(a[1]))] == ["node:A", "node:B", "relation:B|R|A"]
    assert schemas.normalize("entities", "g", "{broken")[2] == "normalization_error: JSONDecodeError"
    assert schemas.normalize("text", "g", "")[2] == "empty_normalized_schema"
    rows = spark.createDataFrame([(1, "text", "g", "(:B)-[:R]->(:A)"), (2, "text", "g", "(:B)-[:R]->(:A)"), (3, "text", "h", "")], "id int, kind string, graph string, text string")
    got = {r.id: r for r in schemas.normalize_distinct(rows, "kind", "graph", "text").collect()}
    assert got[1].schema_id == got[2].schema_id == a[0] and got[1].n_units == 3 and got[3].error == "empty_normalized_schema"
