"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def _family(name: str) -> str:
    name = name.lower()
    if name.startswith(("timestamp", "date")):
        return "time"
    if name.startswith(("varchar", "string")):
        return "text"
    return {"long": "bigint", "integer": "int", "short": "smallint", "float": "float"}.get(name, name)


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and the SQL result; empty when they agree."""
    found = con.execute(sql)
    other_types = {c[0]: _family({"INTEGER": "int", "BIGINT": "bigint"}.get(str(c[1]), str(c[1])))
                   for c in found.description}
    other = [dict(zip(other_types, r)) for r in found.fetchall()]
    types = {f.name: _family(f.dataType.simpleString()) for f in df.schema.fields}
    if set(types) != set(other_types):
        return [f"columns {sorted(types)} against {sorted(other_types)}"]
    diff = [f"type of {c}: {types[c]} against {other_types[c]}" for c in types if types[c] != other_types[c]]
    names = sorted(types)
    mine = sorted(tuple(_cell(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(_cell(r[c]) for c in names) for r in other)
    if len(mine) != len(theirs):
        diff.append(f"{len(mine)} rows against {len(theirs)}")
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        diff.append(f"{len(wrong)} rows differ, first {names}: {wrong[0][0]} against {wrong[0][1]}")
    if not mine and not theirs:
        diff.append("both are empty")
    return diff
