"""Licence expressions of any length."""

from factloom.llm import licenses


def test_long_license_expressions():
    names = [f"Part-{k}-License" for k in range(100)]
    machine = licenses.automaton()
    text = f"x\nSPDX-License-Identifier: {' AND '.join(names)} AND proprietary */\nMIT"
    found = licenses.scan(text.encode(), machine)[1]
    assert {label for _, _, kind, label in found if kind == "tag"} == {n.lower() for n in names} | {"proprietary"}
    assert [label for _, _, kind, label in found if kind == "freedom"] == ["0.0"]
    many = "SPDX-License-Identifier: MIT é " * 20_000
    assert {label for _, _, kind, label in licenses.scan(many.encode(), machine)[1] if kind == "tag"} == {"mit"}
