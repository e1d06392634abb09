"""Names of programming languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and aliases of the languages of the index.
EXTENSIONS = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "go": "go", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "h": "cpp", "hxx": "cpp", "cs": "csharp", "lua": "lua", "sql": "sql", "sh": "bash", "bash": "bash", "swift": "swift",
    "hs": "haskell", "lhs": "haskell", "ex": "elixir", "exs": "elixir", "yaml": "yaml", "yml": "yaml", "toml": "toml", "tf": "hcl", "hcl": "hcl", "tfvars": "hcl",
}
ALIASES = {
    "rs": "rust", "py": "python", "ts": "typescript", "js": "typescript", "javascript": "typescript", "kt": "kotlin",
    "golang": "go", "c++": "cpp", "cxx": "cpp", "c#": "csharp", "cs": "csharp",
}
# Short forms of the symbol kinds.
KIND_CODES = {
    "function": "fn", "method": "met", "struct": "str", "class": "cls", "interface": "int", "trait": "trt",
    "enum": "enm", "constant": "cst", "variable": "val", "module": "mod", "import": "imp", "field": "fld",
    "type_alias": "typ", "enum_variant": "var",
}


def lookup(values: dict[str, str], key: Column) -> Column:
    """A literal map, small and constant, folded into the plan."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language(name: Column, path: Column | None = None) -> Column:
    """Lower case, blanks off, aliases resolved; a null or blank name is decided by the path's extension."""
    n = F.nullif(F.lower(F.trim(name)), F.lit(""))
    n = F.coalesce(lookup(ALIASES, n), n)
    return n if path is None else F.coalesce(n, lookup(EXTENSIONS, extension(path)))


def kind(name: Column) -> Column:
    """Lower case, blanks off, short forms spelled out."""
    n = F.lower(F.trim(name))
    return F.coalesce(lookup({v: k for k, v in KIND_CODES.items()}, n), n)
