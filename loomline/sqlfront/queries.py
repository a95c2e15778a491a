"""Which columns of which tables a SELECT reads, and what they become."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomline.sqlfront.tokens import Token, close_of, columns, commas, render, split_at, tokenize

_SET_OPS = ("UNION", "MINUS", "INTERSECT", "EXCEPT")
_CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "CONNECT", "START", "FOR", "FETCH")
_JOIN_WORDS = ("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "OUTER")

MAPPING = (
    "input_object_type input_schema_path input_table_name input_subquery_sql input_table_alias input_field output_object_type output_schema_path "
    "output_table output_subquery_sql output_field_alias expression_sql clause filter_expression_sql"
).split()


def table_name(full: str | None) -> str | None:
    """Last dotted part; of a .txt file its name."""
    if not full:
        return None
    return full.split("\\")[-1] if full.lower().endswith(".txt") else full.split(".")[-1]


def schema_name(full: str | None) -> str | None:
    """First dotted part; of a .txt file its folder, or itself where it has none."""
    if not full:
        return None
    if full.lower().endswith(".txt"):
        return full.split("\\")[0]
    return full.split(".")[0] if "." in full else None


def table_type(full: str | None, subquery: str = "SUBCONSULTA", table: str = "TABLA") -> str | None:
    if not full:
        return None
    return subquery if full.startswith(("SUBQUERY", "MERGE_USING_SUBQUERY")) else table


def conditions(tokens: list[Token]) -> list[list[Token]]:
    """The top-level AND/OR chain, last condition first."""
    while tokens and tokens[0].text == "(" and close_of(tokens, 0) == len(tokens) - 1:
        tokens = tokens[1:-1]
    out: list[list[Token]] = [[]]
    depth = cases = 0
    between = False
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        cases += (t.upper == "CASE") - (t.upper == "END" and cases > 0)
        if depth == 0 and cases == 0 and t.upper == "BETWEEN":
            between = True
        if depth == 0 and cases == 0 and t.upper in ("AND", "OR"):
            if not (t.upper == "AND" and between):
                out.append([])
                continue
            between = False
        out[-1].append(t)
    return [x for x in out if x][::-1]


@dataclass
class Select:
    """One SELECT without set operations; nested queries in it have become names."""

    projections: list[list[Token]] = field(default_factory=list)
    tables: list[tuple[str, str | None]] = field(default_factory=list)  # (full name, alias)
    joins: list[list[Token]] = field(default_factory=list)
    where: list[Token] = field(default_factory=list)


def _clauses(tokens: list[Token]) -> dict[str, list[Token]]:
    out: dict[str, list[Token]] = {}
    name, depth = None, 0
    for i, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.upper in _CLAUSES and not (t.upper == "START" and tokens[i + 1 : i + 2] and tokens[i + 1].upper != "WITH"):
            name = t.upper
            out.setdefault(name, [])
        elif name:
            out[name].append(t)
    return out


def _source(tokens: list[Token]) -> tuple[str, str | None] | None:
    """Full name and alias of one table in FROM."""
    while tokens and tokens[0].text == "(" and close_of(tokens, 0) >= len(tokens) - 2:  # a table in parentheses
        end = close_of(tokens, 0)
        tokens = [*tokens[1:end], *tokens[end + 1 :]]
    if not tokens or tokens[0].kind not in ("word", "quoted", "bind"):
        return None
    parts, i = [tokens[0].name], 1
    while i + 1 < len(tokens) and tokens[i].text in (".", "@"):
        parts.append(("@" if tokens[i].text == "@" else ".") + tokens[i + 1].name)
        i += 2
    rest, k = [], i
    while k < len(tokens):  # what says which part of the table is read
        if tokens[k].upper in ("PARTITION", "SUBPARTITION", "SAMPLE") and k + 1 < len(tokens) and tokens[k + 1].text == "(":
            k = close_of(tokens, k + 1) + 1
        else:
            rest.append(tokens[k])
            k += 1
    rest = [t for t in rest if t.upper != "AS"]
    return "".join(parts), rest[0].name if rest and rest[0].kind in ("word", "quoted") else None


def parse_select(tokens: list[Token]) -> Select:
    parts = _clauses(tokens)
    out = Select()
    shown = parts.get("SELECT", [])
    while shown and shown[0].upper in ("DISTINCT", "ALL", "UNIQUE"):
        shown = shown[1:]
    into = next((i for i, t in enumerate(shown) if t.upper == "INTO"), None)
    out.projections = commas(shown[:into])
    for item in commas(parts.get("FROM", [])):
        pieces = split_at(item, lambda t: t.upper == "JOIN")
        for piece in pieces:
            on = split_at(piece, lambda t: t.upper in ("ON", "USING"))
            while on[0] and on[0][-1].upper in _JOIN_WORDS:
                on[0].pop()
            source = _source(on[0])
            if source:
                out.tables.append(source)
            for cond in on[1:]:
                while cond and cond[-1].upper in _JOIN_WORDS:
                    cond.pop()
                if cond:
                    out.joins.append(cond)
    out.where = parts.get("WHERE", [])
    return out


def _branches(tokens: list[Token]) -> list[list[Token]]:
    """SELECTs between set operations, the last first."""
    tokens = list(tokens)
    while tokens and tokens[0].text == "(" and close_of(tokens, 0) == len(tokens) - 1:
        tokens = tokens[1:-1]
    parts = split_at(tokens, lambda t: t.upper in _SET_OPS)
    out = [p[1:] if p and p[0].upper == "ALL" else p for p in parts][::-1]
    return [b for p in out for b in (_branches(p) if p and p[0].text == "(" else [p])]


def _after_with(tokens: list[Token]) -> list[Token]:
    """The main query behind the common table expressions, whose names stay opaque."""
    if not tokens or tokens[0].upper != "WITH":
        return tokens
    depth = 0
    for i, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.upper == "SELECT":
            return tokens[i:]
    return tokens


def _nested(tokens: list[Token]) -> list[list[Token]]:
    """All queries in parentheses, however deep, but those after EXISTS."""
    out = []
    for i, t in enumerate(tokens):
        if t.text == "(" and i + 1 < len(tokens) and tokens[i + 1].upper in ("SELECT", "WITH") and not (i and tokens[i - 1].upper == "EXISTS"):
            out.append(tokens[i + 1 : close_of(tokens, i)])
    return out


def _count_selects(sql: str) -> int:
    return len(re.findall(r"\bSELECT\b", sql, re.I))


def _hoist(tokens: list[Token], names: dict[str, str]) -> list[Token]:
    """Nested queries become their names."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i].text == "(" and i + 1 < len(tokens) and tokens[i + 1].upper in ("SELECT", "WITH"):
            end = close_of(tokens, i)
            name = names.get(render(tokens[i + 1 : end]))
            if name:
                out.append(Token("word", name))
                i = end + 1
                continue
        out.append(tokens[i])
        i += 1
    return out


def alias_of(tokens: list[Token]) -> str | None:
    """What a projection is called: its alias, or its own name if it is a column."""
    if len(tokens) >= 2 and tokens[-2].upper == "AS":
        return tokens[-1].name
    found = columns(tokens)
    plain = all(t.kind in ("word", "quoted") or t.text in (".", "*") for t in tokens)
    if plain and len(tokens) in (1, 3, 5) and found and tokens[-1].text != "*":
        return found[-1][1]
    last, before = tokens[-1], tokens[-2] if len(tokens) > 1 else None
    if before is not None and last.kind in ("word", "quoted") and last.upper not in ("END", "NULL") and before.text not in (".", "(", ",") and before.kind != "op" or before is not None and before.text == ")" and last.kind in ("word", "quoted"):
        return last.name
    return None


def _expression(tokens: list[Token], alias: str | None) -> tuple[list[Token], str]:
    """The projection without its alias, and its text with `AS`."""
    if len(tokens) >= 2 and tokens[-2].upper == "AS":
        return tokens[:-2], f"{render(tokens[:-2])} AS {tokens[-1].text}"
    found = columns(tokens)
    if alias is not None and not (found and found[-1][1] == alias and all(t.kind in ("word", "quoted") or t.text == "." for t in tokens) and len(tokens) in (1, 3, 5)):
        return tokens[:-1], f"{render(tokens[:-1])} AS {tokens[-1].text}"
    return tokens, render(tokens)


def _rows(select: Select, output: str | None, columns_out: list[str], queries: dict[str, str]) -> list[dict]:
    by_alias = {a.upper(): full for full, a in select.tables if a}
    by_name = {full.upper(): full for full, _ in select.tables} | {table_name(full).upper(): full for full, _ in select.tables}

    def resolve(qualifier: str | None) -> str | None:
        if qualifier is None:
            return select.tables[0][0] if len(select.tables) == 1 else None
        return by_alias.get(qualifier.upper()) or by_name.get(qualifier.upper())

    where_sql = f"WHERE {render(select.where)}" if select.where else None
    named = [alias_of(p) for p in select.projections]
    if len(columns_out) == len(named):
        named = [a if a is not None else c for a, c in zip(named, columns_out, strict=True)]
    found: list[tuple[str, list[Token], str, str | None]] = []
    for p, name in zip(select.projections, named, strict=True):
        body, text = _expression(p, alias_of(p))
        found.append(("select", body, text, name))
    found += [("join_on", on, render(on), None) for on in select.joins]
    found += [("where", c, render(c), None) for c in conditions(select.where)]

    rows, seen = [], set()
    for clause, body, text, name in found:
        if len(body) == 1 and body[0].text == "*":
            inputs = [("*", full, alias) for full, alias in select.tables]
        else:
            inputs = [(c, resolve(q), q) for q, c in columns(body) if c not in queries] or [("", None, None)]
        for column, full, alias in inputs:
            key = alias, column, name, text
            if key in seen:
                continue
            seen.add(key)
            rows.append(
                dict.fromkeys(MAPPING)
                | {
                    "input_object_type": table_type(full), "input_schema_path": schema_name(full), "input_table_name": table_name(full), "input_subquery_sql": queries.get(table_name(full)),
                    "input_table_alias": alias, "input_field": column, "output_object_type": table_type(output), "output_schema_path": schema_name(output),
                    "output_table": table_name(output), "output_subquery_sql": queries.get(table_name(output)), "output_field_alias": name, "expression_sql": text, "clause": clause,
                    "filter_expression_sql": None if clause != "where" or where_sql is None else where_sql if column in text else where_sql.replace("WHERE ", ""),
                }
            )
    return rows


def map_select(tokens: list[Token] | str, statement_id: int, output: str | None, columns_out: list[str] | None = None) -> list[dict]:
    """Mapping rows of a query and of all queries nested in it, the nested ones first."""
    if isinstance(tokens, str):
        tokens = tokenize(tokens)
    tokens = [t for t in tokens if t.text != ";"]
    while tokens and tokens[0].text == "(" and close_of(tokens, 0) == len(tokens) - 1:
        tokens = tokens[1:-1]
    main = _after_with(tokens)
    inner = {render(q): q for q in _nested(main)}
    # by number of SELECTs, then by text from the last to the first; numbers are given in that order
    order = sorted(sorted(inner, reverse=True), key=_count_selects)
    names = {sql: f"SUBQUERY_{statement_id:03d}_{i:02d}" for i, sql in enumerate(order)}
    queries = {name: sql for sql, name in names.items()}
    rows = []
    for sql in order:
        for branch in _branches(_after_with(inner[sql])):
            rows += _rows(parse_select(_hoist(branch, names)), names[sql], [], queries)
    for branch in _branches(main):
        rows += _rows(parse_select(_hoist(branch, names)), output, columns_out or [], queries)
    return rows
