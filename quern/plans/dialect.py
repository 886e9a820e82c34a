"""Functions that Spark and DuckDB spell apart: @name(arguments) in the portable SQL."""

from __future__ import annotations

import re

_SQUASH = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' '{g}))"
# The scripts of titles that have markers of no language.
_SCRIPTS = "[฀-๿぀-ヿ一-鿿؀-ۿ가-힯]"

SPARK = {
    "type": "CASE typeof({0}) WHEN 'string' THEN 'text' WHEN 'double' THEN 'real' ELSE 'whole' END",
    "size": "size({0})",
    "distinct": "array_distinct({0})",
    "common": "size(array_intersect({0}, {1}))",
    "split": "filter(split({0}, ' '), t_ -> t_ <> '')",
    "squash": _SQUASH.replace("{g}", ""),
    "findall": "regexp_extract_all({0}, {1}, 0)",
    "filter": "filter({0}, t_ -> t_ IN ({rest}))",
    "each": "explode({0})",
    "range": "sequence({0}, {1})",
    "hex": "CAST(conv({0}, 16, 10) AS BIGINT)",
    "bits": "bit_count({0} ^ {1})",
    "dot": "aggregate(zip_with({0}, {1}, (x_, y_) -> CAST(x_ AS DOUBLE) * CAST(y_ AS DOUBLE)), 0e0, (s_, z_) -> s_ + z_)",
    "quantile": "percentile({0}, {1})",
    "last": "element_at({0}, nullif(size({0}), 0))",
    "couples": "CASE WHEN size({0}) > 1 THEN transform(sequence(1, size({0}) - 1), k_ -> named_struct('a', element_at({0}, k_), 'b', element_at({0}, k_ + 1))) END",
    "part": "slice({0}, ({1} - 1) * 16 + 1, 16)",
    "pairs": "CASE WHEN size({0}) > 1 THEN transform(sequence(1, size({0}) - 1), k_ -> concat(element_at({0}, k_), ' ', element_at({0}, k_ + 1))) ELSE CAST(array() AS ARRAY<STRING>) END",
    "grams": "flatten(transform(sequence(2, least(5, length({0}))), n_ -> transform(sequence(1, length({0}) - n_ + 1), k_ -> substr({0}, k_, n_))))",
    "strip": r"regexp_replace({0}, '[^\\pL\\pN\\s]', '')",
    "ascii": r"regexp_replace({0}, '[^\\x00-\\x7F]', '')",
    "latin": f"regexp_replace({{0}}, '{_SCRIPTS}', '')",
}
DUCKDB = {
    "type": "CASE typeof({0}) WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'real' ELSE 'whole' END",
    "size": "len({0})",
    "distinct": "list_distinct({0})",
    "common": "len(list_intersect({0}, {1}))",
    "split": "list_filter(string_split({0}, ' '), lambda t_: t_ <> '')",
    "squash": _SQUASH.replace("{g}", ", 'g'"),
    "findall": "regexp_extract_all({0}, {1})",
    "filter": "list_filter({0}, lambda t_: t_ IN ({rest}))",
    "each": "unnest({0})",
    "range": "range({0}, {1} + 1)",
    "hex": "('0x' || {0})::BIGINT",
    "bits": "bit_count(xor({0}, {1}))",
    "dot": "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))",
    "quantile": "quantile_cont({0}, {1})",
    "last": "{0}[len({0})]",
    "couples": "[{{'a': {0}[k_], 'b': {0}[k_ + 1]}} for k_ in range(1, len({0}))]",
    "part": "{0}[({1} - 1) * 16 + 1:{1} * 16]",
    "pairs": "[{0}[k_] || ' ' || {0}[k_ + 1] for k_ in range(1, len({0}))]",
    "grams": "flatten([[substr({0}, k_, n_) for k_ in range(1, length({0}) - n_ + 2)] for n_ in range(2, least(5, length({0})) + 1)])",
    "strip": r"regexp_replace({0}, '[^\pL\pN\s]', '', 'g')",
    "ascii": r"regexp_replace({0}, '[^\x00-\x7F]', '', 'g')",
    "latin": f"regexp_replace({{0}}, '{_SCRIPTS}', '', 'g')",
}


def _arguments(text: str) -> tuple[list[str], int]:
    """The arguments of a call whose text begins after its parenthesis, and the length up to the closing one."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            if not depth:
                return [*out, text[last:i].strip()], i
            depth -= 1
        elif not quoted and not depth and c == ",":
            out.append(text[last:i].strip())
            last = i + 1
    raise ValueError(f"unbalanced: {text[:60]}")


def spelled(sql: str, names: dict[str, str]) -> str:
    """The SQL with all @name(arguments) written in one engine's functions, inner calls first."""
    while calls := list(re.finditer(r"@(\w+)\(", sql)):
        m = calls[-1]
        args, n = _arguments(sql[m.end() :])
        done = names[m.group(1)].format(*args, rest=", ".join(args[1:]))
        sql = sql[: m.start()] + done + sql[m.end() + n + 1 :]
    return sql
