"""JSX is parsed; markup in strings or comments hides no error."""

import pytest

from codeloom.llm.parsing import parse

VALID = [
    'import x from "y";\nfunction A() {\n  return (\n    <div className="a" id=\'b\' {...rest} data-x hidden>\n      Text, it\'s & more; return\n      {a ? <B.C on={() => { f(); }} /> : null}\n      {/* note */}\n      <>{items.map((i) => <li key={i}>{i}</li>)}</>\n      <input disabled />\n    </div>\n  );\n}\n',
    "const a = <A<string> b={1 < 2} c=<d/> />;\nconst g = <T,>(x: T) => x;\nconst h = <T extends U>(x: T) => <b>{x}</b>;\n",
    "const a = b && <p>1</p>;\nif (a < 3 && b > 2) { c(); }\nconst m: Map<string, number> = new Map();\nexport default () => <svg:a x:y=\"1\"/>\n",
    'const s = "</div>"; // <br/>\nconst x = <string>y;  // a type assertion\n',
]
BROKEN = [
    'const s = "</div>";\nfunction f( {\n', "// see <br/>\nlet a = ;\n", "const s = `<b/>`;\n<<<<<<< HEAD\nlet a = 1;\n", 'const s = "<br/>";\nfn main() { let mut x = 1; }\n',
    "const a = <div><span></div></span>;\n", "const a = <div>some text;\n", "const a = <div b={}>x</div>;\n", "const a = <div b={f(}>x</div>;\n", "const a = <div>{if (x) y}</div>;\n", "const a = <div>{a; b}</div>;\n", "const a = <div>{a b}</div>;\n",
    "const a = <a/><b/>;\n", "const a = <div {x}>y</div>;\n", "const a = <div>a > b</div>;\n", "const a = <div>x</div>;\nfunction f( {\n", "const a = <div b=>x</div>;\n", "const a = (<div>\n  <p>x</p>\n",
]


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    assert parse(text, "typescript") is None


@pytest.mark.parametrize("text", BROKEN)
def test_broken(text):
    assert parse(text, "typescript") is not None


def test_a_cut_anywhere_within_an_element_is_found():
    text = VALID[0]
    for k in range(text.index("<div"), text.index("</div>")):
        assert parse(text[:k], "typescript") is not None, text[:k]
