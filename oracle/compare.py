"""Run queries beside their SQL: ``python -m oracle.compare SF_DIR [name ...]``."""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
}


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(row[i] for i in order)) for row in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(df, connection, sql: str) -> list[str]:
    """Differences between a Spark result and the SQL result; empty when equal."""
    problems = []
    rows = [tuple(r) for r in df.collect()]
    cursor = connection.execute(sql)
    described = [(c[0], str(c[1])) for c in cursor.description]
    expected = cursor.fetchall()
    schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wanted = {c: TYPES.get(t, t) for c, t in described}
    if schema != wanted:
        problems.append(f"schema {set(schema.items()) ^ set(wanted.items())}")
    if len(rows) != len(expected):
        problems.append(f"rows {len(rows)} != {len(expected)}")
    left, a = _digest(list(df.columns), rows)
    right, b = _digest([c for c, _ in described], expected)
    if left != right:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"{len(only_a)} rows differ: {only_a[:2]} / {only_b[:2]}")
    return problems


def main(sf_dir: str, names: list[str]) -> int:
    from glycospan.session import get_session
    from oracle.registry import QUERIES, SQL

    spark = get_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in SQL:
                problems = compare(df, connection, SQL[name])
                verdict = "equal" if not problems else "DIFFERENT " + "; ".join(problems)
            else:
                verdict, problems = f"rows only: {df.count()}", []
        except Exception as failure:  # noqa: BLE001
            problems, verdict = [failure], f"ERROR {type(failure).__name__}: {str(failure)[:600]}"
        failed += bool(problems)
        print(f"{name:36s} {time.time() - started:6.1f}s {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
