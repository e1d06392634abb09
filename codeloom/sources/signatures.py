"""The parts of a function's header: generic parameters, parameters and return type, for every language with functions.

A header is read from its name on: an optional list of generic parameters, the list of parameters, and what stands before
(Java, C#, C++) or after (the others) as the type it returns. Lists are split at commas outside of all brackets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, CLOSE = "([{<", ")]}>"
# Words before a name that aren't part of its type.
MODIFIERS = frozenset("public private protected internal static final abstract virtual override async sealed partial extern unsafe inline constexpr explicit friend const synchronized native default new readonly open suspend operator infix tailrec external export declare function fn func fun def pub mut ref out in params this vararg noinline crossinline val var".split())
TYPE_FIRST = frozenset(["java", "csharp", "cpp"])
TYPE_LAST_ARROW = frozenset(["rust", "python", "swift"])
PARAM = pa.struct([("name", pa.string()), ("type_annotation", pa.string()), ("is_mutable", pa.bool_()), ("is_self", pa.bool_()), ("is_variadic", pa.bool_()), ("default_value", pa.string())])
GENERIC = pa.struct([("name", pa.string()), ("bounds", pa.list_(pa.string())), ("default", pa.string())])
PARTS = "generic_params array<struct<name:string,bounds:array<string>,default:string>>, params array<struct<name:string,type_annotation:string,is_mutable:boolean,is_self:boolean,is_variadic:boolean,default_value:string>>, return_type string"


def _masked(text: str) -> str:
    """The text with arrows, comparisons and string contents made harmless to the count of brackets, at the same length."""
    text = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', lambda m: '"' + "_" * (len(m[0]) - 2) + '"' if len(m[0]) > 1 else m[0], text)
    return re.sub(r"->|=>|<=|>=|<<|operator\s*[<>=!+*/-]+", lambda m: "_" * len(m[0]), text)


def split_top(text: str, sign: str = ",") -> list[str]:
    """The parts of a text between signs outside of all brackets, without blanks around; empty ones are left out."""
    mask, depth, last, out = _masked(text), 0, 0, []
    for i, c in enumerate(mask):
        if c in OPEN:
            depth += 1
        elif c in CLOSE:
            depth -= 1
        elif c == sign and depth == 0:
            out.append(text[last:i])
            last = i + 1
    out.append(text[last:])
    return [x.strip() for x in out if x.strip()]


def closing(mask: str, at: int) -> int:
    """Where the bracket at a place closes; the end of the text if it doesn't."""
    depth = 0
    for i in range(at, len(mask)):
        depth += (mask[i] in OPEN) - (mask[i] in CLOSE)
        if depth == 0:
            return i
    return len(mask)


def _default(text: str) -> tuple[str, str | None]:
    mask = _masked(text)
    depth = 0
    for i, c in enumerate(mask):
        depth += (c in OPEN) - (c in CLOSE)
        if c == "=" and depth == 0:
            return text[:i].strip(), text[i + 1 :].strip() or None
    return text.strip(), None


def generic(text: str, language: str) -> tuple:
    """(name, bounds, default) of a generic parameter."""
    head, default = _default(text)
    if language == "typescript" or language == "java":
        name, _, bound = head.partition(" extends ")
    elif language == "go":
        name, _, bound = head.partition(" ")
    elif language == "cpp":
        name, bound = head.split()[-1] if head.split() else "", ""
    else:
        name, _, bound = head.partition(":")
    name = re.sub(r"^(?:const|in|out|reified|typename|class)\s+", "", name.strip())
    sign = "&" if language == "java" else "|" if language == "go" else "+"
    return name, split_top(bound, sign), default


def parameter(text: str, language: str) -> tuple | None:
    """(name, type, is mutable, is self, is variadic, default) of a parameter."""
    text = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s+|\[[^\]]*\]\s+|#\[[^\]]*\]\s*)+", "", text.strip())
    if text in ("/", "*", "...") or not text:
        return ("...", None, False, False, True, None) if text == "..." else None
    head, default = _default(text)
    if language in TYPE_FIRST:
        variadic = "..." in head or head.startswith("params ")
        head = re.sub(r"^(?:(?:final|ref|out|in|params|this|scoped)\s+)+", "", head.replace("...", " "))
        m = re.match(r"(.*?[\s&*>\]])\s*(\w+)((?:\[[^\]]*\])*)$", head, re.S)
        if m is None or not m[1].strip():
            return head, None, False, False, variadic, default
        kind = re.sub(r"\s+", " ", (m[1].strip() + m[3]))
        mutable = language == "cpp" and ("&" in kind or "*" in kind) and not kind.startswith("const ")
        return m[2], kind, mutable, False, variadic, default
    if language == "go":
        name, _, kind = head.partition(" ")
        return (name, kind.replace("...", "").strip() or None, False, False, kind.strip().startswith("..."), None)
    variadic = head.startswith(("*", "...")) or "vararg " in head
    name, colon, kind = head.partition(":")
    mutable = bool(re.search(r"\bmut\b", name if colon else head)) or (language == "rust" and kind.strip().startswith("&mut"))
    bare = re.sub(r"&\s*(?:'\w+\s*)?|\b(?:mut|public|private|protected|readonly|override|vararg|noinline|crossinline|val|var|ref|inout)\b\s*|^\*+|^\.\.\.|\?$", "", name.strip()).strip()
    if language == "swift":
        bare = bare.split()[-1] if bare else bare
    is_self = bare in ("self", "this") or (language == "python" and bare == "cls")
    if is_self and not colon and name.strip() != bare:
        return bare, None, mutable, True, False, default
    return bare, re.sub(r"\s+", " ", kind.strip()) or None, mutable, is_self, variadic, default


def parts(signature: str, name: str, language: str) -> tuple[list | None, list | None, str | None]:
    """(generic parameters, parameters, return type) of a header; None for a list that isn't there."""
    text = re.sub(r"\s+", " ", signature).strip()
    mask = _masked(text)
    m = re.search(rf"(?<![\w$]){re.escape(name)}\s*(?=[(<\[])", mask)
    if m is None:
        return None, None, None
    at, before, generics = m.end(), text[: m.start()], None
    if mask[at] in "<[":
        end = closing(mask, at)
        generics = [generic(x, language) for x in split_top(text[at + 1 : end])]
        at = end + 1
        while at < len(mask) and mask[at] == " ":
            at += 1
    elif (g := re.match(r"(?:[\w\s@]*?\s)?(?:fun|template)?\s*<", before)) and language in ("kotlin", "java", "cpp"):
        start = g.end() - 1
        end = closing(_masked(before), start)
        generics, before = [generic(x, language) for x in split_top(before[start + 1 : end])], before[:start] + " " + before[end + 1 :]
    if at >= len(mask) or mask[at] != "(":
        return generics, None, None
    end = closing(mask, at)
    params = [p for x in split_top(text[at + 1 : end]) if (p := parameter(x, language)) is not None]
    if language == "go":  # names before a type share it; types alone have no name
        late: str | None = None
        fixed = []
        alone = all(p[1] is None for p in params)
        for p in reversed(params):
            if p[1] is None and not alone:
                p = (p[0], late, *p[2:])
            late = p[1]
            fixed.append(("_", p[0], *p[2:]) if alone else p)
        params = fixed[::-1]
    after = text[end + 1 :].strip()
    if language in TYPE_FIRST:
        words = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*|\[[^\]]*\]\s*)+", "", before).split()
        while words and words[0] in MODIFIERS and not (language == "cpp" and words[0] == "const"):
            words = words[1:]
        kind = " ".join(words)
        kind = re.sub(r"\s*\w+::\s*$|(?<=[\s&*])[\w:]+::$", "", kind).strip()
        trailing = re.match(r"(?:const|noexcept|override|final|\s)*->\s*([^{]+)", after) if language == "cpp" else None
        return generics, params, trailing[1].strip() if trailing else kind or None
    if language in TYPE_LAST_ARROW:
        r = re.search(r"->\s*(.+?)(?:\s+where\b.*|\s*[{;:])?$", after)
    elif language == "go":
        r = re.match(r"\s*(.+?)\s*\{?$", after)
    else:
        r = re.match(r":\s*(.+?)\s*(?:[{=;].*|\bwhere\b.*)?$", after)
    return generics, params, r[1].strip() if r else None


def with_parts(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, generic_params, params, return_type) of the headers of `df` (key, name, language, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parts(s, n, lg or "") for n, lg, s in zip(*(b.column(c).to_pylist() for c in ("name", "language", "signature")), strict=True)]
            g, p, r = zip(*rows, strict=True) if rows else ((), (), ())
            names_g, names_p = [f.name for f in GENERIC], [f.name for f in PARAM]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if x is None else [dict(zip(names_g, y, strict=True)) for y in x] for x in g], pa.list_(GENERIC)), pa.array([None if x is None else [dict(zip(names_p, y, strict=True)) for y in x] for x in p], pa.list_(PARAM)), pa.array(list(r), pa.string())],
                names=[key, "generic_params", "params", "return_type"],
            )

    return df.filter("name is not null and signature is not null").select(key, "name", "language", "signature").mapInArrow(run, f"{key} string, {PARTS}")
