"""Definitions without a name, and another language's directives."""

import pytest

from codeloom.llm.parsing import parse


@pytest.mark.parametrize("text", ["def (x):\n    pass\n", "class :\n    pass\n", "class (A):\n    pass\n", "async def (x):\n    pass\n"])
def test_python_definitions_need_a_name(text):
    assert parse(text, "python") is not None


def test_csharp_has_only_its_own_directives():
    assert parse("#include <string>\nvoid f(std::string& s) { s.clear(); }\n", "csharp") is not None
    assert parse("#nullable enable\n#if DEBUG\n# region A\nclass X { }\n#endregion\n#endif\n", "csharp") is None
