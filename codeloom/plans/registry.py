"""The modules whose QUERIES and ORACLES make up the engine's registry."""

MODULES = [
    "codeloom.operators.orphans",
    "codeloom.operators.hierarchy",
    "codeloom.operators.lookup",
    "codeloom.operators.stats",
    "codeloom.operators.graph",
    "codeloom.operators.tags",
    "codeloom.operators.search",
    "codeloom.functions.text",
    "codeloom.operators.incremental",
    "codeloom.streaming.watch",
    "codeloom.sources.extract",
    "codeloom.operators.project",
    "codeloom.operators.access",
    "codeloom.operators.context",
    "codeloom.sources.sinks",
    "codeloom.sources.workspaces",
]
