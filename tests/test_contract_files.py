"""The contract language on hand-written files."""

import pytest
from sondage.operators import contracts as op
from sondage.sources import contract_files as C

LIFECYCLE = """// how a ticket lives
state-machine Ticket.state {
  origin "docs/tickets.md" "Life" 3..9
  scope {
    entity Entity:Ticket
  }
  states Enum:TicketState
  initial [open]
  transitions {
    open -> [closed, waiting]
    waiting -> open
  }
}
enum TicketState { values [open,
    waiting, closed] }
fallback ticket.owner {
  target owner
  default "no \\"one\\""
  limit -3
}
"""


def test_tables(spark):
    files = spark.createDataFrame([("a.tc", LIFECYCLE), ("b.tc", "enum X {\n values [a b]\n}"), ("c.tc", None), ("d.tc", "enum Y {")], "path string, text string")
    rows = C.read_contracts(files).cache()
    assert {(r.kind, r.identity, r.line_start, r.line_end) for r in rows.where("error is null").collect()} == {("state-machine", "Ticket.state", 2, 13), ("enum", "TicketState", 14, 15), ("fallback", "ticket.owner", 16, 20)}
    assert {(r.path, r.error) for r in rows.where("error is not null").collect()} == {("b.tc", "line 2: expected ',' or ']', found 'b'"), ("d.tc", "line 1: expected '}', found the end")}
    assert [(r.origin_source, r.origin_section, r.origin_start, r.origin_end) for r in rows.where("kind = 'state-machine'").collect()] == [("docs/tickets.md", "Life", 3, 9)]
    assert [(r["name"], r["values"]) for r in C.enums(rows).collect()] == [("TicketState", ["open", "waiting", "closed"])]
    assert {(r["from"], r["to"]) for r in C.transitions(rows).collect()} == {("open", "closed"), ("open", "waiting"), ("waiting", "open")}
    assert {(r.key, r.value) for r in C.properties(rows, "fallback").collect()} == {("target", "owner"), ("default", 'no "one"'), ("limit", "-3")}
    refs = C.references(rows)
    assert {r.ref for r in refs.collect()} == {"Entity:Ticket", "Enum:TicketState"}
    known = spark.createDataFrame([("Enum:TicketState",)], "identity string")
    assert [r.ref for r in op.dangling(refs.select("ref"), known).collect()] == ["Entity:Ticket"]


@pytest.mark.parametrize("bad", ["{", "enum", "enum A { values ] }", 'enum A { x "open }', "enum A { } }"])
def test_errors_have_lines(bad):
    with pytest.raises(C.ContractError, match="line 1"):
        C.parse_contracts(bad)
