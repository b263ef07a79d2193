"""Provenance of a query: the same patterns, returning the ids of every node that took part.

Keywords count in upper case only, and a query whose parts do not begin with MATCH has no provenance.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cypher import Token, lex

# Words that begin a clause, and the clauses that are kept.
STARTS = {"MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "CREATE", "SET", "DELETE", "MERGE", "UNWIND", "ORDER", "LIMIT", "SKIP", "FOREACH", "CALL", "YIELD"}
KEPT = {"MATCH", "OPTIONAL", "WHERE", "WITH"}


def _parts(query: str) -> list[list[Token]]:
    """Token lists between UNIONs; of a leading CALL { } what stands inside."""
    tokens = lex(query)
    if tokens and tokens[0].text == "CALL":
        level, inner = 0, []
        for i, t in enumerate(tokens[1:], 1):
            if t.kind == "sign" and t.text == "}":
                level -= 1
                if not level:
                    tokens = inner if i + 1 < len(tokens) else tokens
                    break
            if level:
                inner.append(t)
            if t.kind == "sign" and t.text == "{":
                level += 1
    out: list[list[Token]] = [[]]
    for t in tokens:
        if t.kind == "word" and t.text == "UNION":
            out.append([])
        else:
            out[-1].append(t)
    return out


def _clauses(tokens: list[Token]) -> list[list[Token]]:
    out: list[list[Token]] = []
    for i, t in enumerate(tokens):
        follows = i and tokens[i - 1].text in ("OPTIONAL",) and t.text == "MATCH"
        if t.kind == "word" and t.text in STARTS and not follows:
            out.append([])
        if out:
            out[-1].append(t)
    return out


class _Rewriter:
    """Writes clauses with names for what has none."""

    def __init__(self, query: str):
        self.query, self.nodes, self.relations, self.variables = query, 0, 0, set()

    def write(self, clause: list[Token]) -> str:
        patterns, out, at = clause[0].text in ("MATCH", "OPTIONAL"), [], clause[0].start
        for i, t in enumerate(clause):
            after = clause[i + 1].text if i + 1 < len(clause) else ""
            name = ""
            if patterns and t.kind == "sign" and after == ":" and t.text in "([":
                if t.text == "[":
                    name, self.relations = f"rtmp{self.relations}", self.relations + 1
                elif self._closes(clause, i):
                    name, self.nodes = f"ntmp{self.nodes}", self.nodes + 1
                    self.variables.add(name)
            elif patterns and t.text == "(" and i + 2 < len(clause) and clause[i + 1].kind == "word" and clause[i + 2].text in (":", ")"):
                self.variables.add(after)
            out += [self.query[at : t.end], name]
            at = t.end
        return "".join(out).strip()

    @staticmethod
    def _closes(clause: list[Token], i: int) -> bool:
        """Whether one label, and perhaps properties, fill the parenthesis at i."""
        j = i + 3
        if j < len(clause) and clause[j].text == "{":
            while j < len(clause) and clause[j].text != "}":
                j += 1
            j += 1
        return j < len(clause) and clause[j].text == ")" and clause[i + 2].name is not None


def provenance(query: str, name: str = "elemId") -> str:
    made = []
    for part in _parts(query):
        if not part or part[0].text != "MATCH":
            continue
        writer, kept = _Rewriter(query), []
        for clause in _clauses(part):
            if clause[0].text not in KEPT:
                break
            if clause[0].text == "WITH":
                if any(t.kind == "word" and t.text.lower() == "as" for t in clause):
                    break
                kept.append("WITH *")
            else:
                kept.append(writer.write(clause))
        while kept and kept[-1] == "WITH *":
            kept.pop()
        ids = " + ".join(f"collect(distinct elementId({v}))" for v in sorted(writer.variables)) or "[]"
        made.append(f"{' '.join(kept)} WITH {ids} AS elemIds UNWIND elemIds AS elemId RETURN elemId AS {name}")
    return " UNION ".join(made) or f"UNWIND [] AS elemId RETURN elemId AS {name}"


@F.pandas_udf(T.StringType())
def provenance_udf(query: pd.Series) -> pd.Series:
    return query.map(lambda q: None if q is None else provenance(q))
