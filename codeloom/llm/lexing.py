"""Comments and strings of source texts by delimiter family, and the language a text is really written in."""

from __future__ import annotations

import re

# Which delimiters each language has.
FAMILY = {"rust": "rust", "java": "c", "kotlin": "c", "go": "go", "cpp": "c", "csharp": "cs", "typescript": "ts", "python": "hash", "lua": "dash"}
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DQ, _SQ, _TICK = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)', r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)", r"`(?:[^`\\]|\\.)*(?:`|\Z)"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"
_TRIPLE = r'"""(?:[^\\]|\\.)*?(?:"""|\Z)'
PATTERNS = {
    "c": rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_TRIPLE}|{_DQ})|{_CHAR}",
    "cs": rf'(?P<comment>{_LINE}|{_BLOCK})|(?P<string>[$@]*@[$@]*"(?:[^"]|"")*(?:"|\Z)|{_TRIPLE}|{_DQ})|{_CHAR}',
    "go": rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_DQ}|`[^`]*(?:`|\Z))|{_CHAR}",
    "rust": rf'(?P<comment>{_LINE}|{_BLOCK})|(?P<string>\bb?r(?P<h>#*)"(?:.*?)(?:"(?P=h)|\Z)|{_DQ})|{_CHAR}',
    "ts": rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_DQ}|{_SQ}|{_TICK})",
    "hash": rf"(?P<comment>\#[^\n]*)|(?P<string>{_TRIPLE}|'''(?:[^\\]|\\.)*?(?:'''|\Z)|{_DQ}|{_SQ})",
    "dash": rf"(?P<comment>--\[(?P<h>=*)\[.*?(?:\](?P=h)\]|\Z)|--[^\n]*)|(?P<string>{_DQ}|{_SQ}|\[(?P<g>=*)\[.*?(?:\](?P=g)\]|\Z))",
}
_COMPILED = {k: re.compile(v, re.S) for k, v in PATTERNS.items()}


def lex(body: str, family: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) of comments, strings and, in Python, strings that stand as a statement ('doc')."""
    out = []
    for m in _COMPILED[family].finditer(body):
        kind = m.lastgroup if m.lastgroup in ("comment", "string") else ("comment" if m["comment"] is not None else "string" if m["string"] is not None else None)
        if kind is None:
            continue
        if kind == "string" and family == "hash":
            head = body.rfind("\n", 0, m.start()) + 1
            if body[head : m.start()].strip(" \t") == "":
                kind = "doc"
        out.append((kind, m.start(), m.end(), m[0]))
    return out


# Constructs that tell the languages of the index apart; each counts once a line.
SIGNS = {
    "rust": r"^use [\w:]+(?:::|;)|^\s*(?:pub(?:\(\w+\))? )?(?:fn \w+|struct \w+|enum \w+|trait \w+|mod \w+)|^impl\b|\blet mut \w+|\w+!\(|-> &?\w+ \{$",
    "python": r"^(?:from [\w.]+ )?import \w+(?:[.\w, ]*)$|^\s*def \w+\(.*|^\s*class \w+.*:$|^\s*(?:if|for|while|elif|else|try|with)\b.*:$|\bself\b",
    "typescript": r"^import .* from [\"']|^\s*export (?:default |async |abstract )*(?:function|class|const|interface|type|enum)|\b(?:let|const) \w+(?:: \w+)? = |\): (?:number|string|void|boolean|Promise<)|=>|===|\bfunction\s*\*?\s*\w*\(|console\.\w+\(",
    "java": r"^package [\w.]+;|^import (?:static )?[\w.*]+;|^\s*(?:public|private|protected) .*[({]$|System\.\w+\.print|\bfinal \w+ ",
    "kotlin": r"^package [\w.]+$|^import [\w.*]+$|^\s*(?:\w+ )*fun (?:<.*> )?[\w.]+\(|^\s*va[lr] \w+|println\(|\bdata class\b",
    "go": r"^package \w+$|^import (?:\"|\()|^func (?:\(.*\) )?\w+\(|:= |^type \w+ (?:struct|interface)|fmt\.\w+\(",
    "cpp": r"^\s*#\s*(?:include|define|ifdef|ifndef|pragma|endif)|^namespace \w+ \{|std::|^\s*(?:public|private|protected):$|^template\s*<|\bconst \w+[&*]",
    "csharp": r"^using [\w.]+;|^namespace [\w.]+[;{]?$|Console\.\w+|^\s*(?:public|private|internal|protected) (?:static |async |override |virtual )*[\w<>\[\]]+ \w+\(.*\)$|\bstring\.\w+",
    "lua": r"^local \w+|^(?:local )?function [\w.:]+\(|^\s*end\b|\bthen$|\bdo$|^return \{",
}
_SIGNS = {k: re.compile(v, re.M) for k, v in SIGNS.items()}


def real_language(body: str, claimed: str | None) -> str | None:
    """The claimed language, unless another one's constructs are clearly more in the text."""
    own = len(_SIGNS[claimed].findall(body)) if claimed in _SIGNS else 0
    if own >= 4:  # a text in another language has hardly any of this one's constructs
        return claimed
    scores = {k: sum(1 for _ in p.finditer(body)) for k, p in _SIGNS.items()}
    best = max(scores, key=lambda k: scores[k])
    return best if scores[best] >= 2 and scores[best] > 2 * own else claimed if claimed in FAMILY or not scores[best] else best
