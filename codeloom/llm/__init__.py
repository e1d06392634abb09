"""Operators for language-model training data. Nothing outside this subpackage imports it."""

MODULES = ["codeloom.llm.docpairs", "codeloom.llm.handwritten", "codeloom.llm.mixing", "codeloom.llm.natural", "codeloom.llm.parsing", "codeloom.llm.tokenize", "codeloom.llm.truncation"]
