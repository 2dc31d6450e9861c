"""Merkle manifest against a plain recomputation, over trees of several stored levels."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spliceflow.llm import merkle, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def _steps(levels, p):
    out = []
    for level in levels[:-1]:
        run = level[p // 3 * 3 : p // 3 * 3 + 3]
        out.append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        p //= 3
    return out


def _expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], _leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = _tree([x[1] for x in groups[g]])
    top = _tree([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for p, (id, h, r) in enumerate(groups[g]):
            steps = _steps(trees[g], p) + _steps(top, k)
            tampered = zlib.crc32(str("" if id is None else id).encode()) % 2 == 0 and r[4] is not None
            at = _leaf(*r[:4], r[4].replace("\n", "")) if tampered else h
            for left, right in steps:
                at = H(left, at, right)
            out.append((id, h, trees[g][-1][0], root, H(*(x + y for x, y in steps)), at, at == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def query(spark, tmp_path_factory):
    def run(rows):
        folder = str(tmp_path_factory.mktemp("sf"))
        spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
        got = queries.op11_merkle_manifest(spark, folder)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return sorted((tuple(r) for r in got.collect()), key=repr), folder

    return run


def test_trees_of_all_sizes(query):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "a", "a\nb", "\n", "é\n中", "x" * 500])
    sizes = {None: 5, "": 1, "a": 81, "b": 82, "c": 80, "é": 243, "Z": 2, "z": 3, "big": 7000, "with space": 244}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n, source, rng.choice([None, "en", ""]), rng.choice([None, 1, -3]), text()))
            n += rng.choice([0, 1, 1, 5])
    rows += [(None, "b", None, None, None), (None, "b", "en", 2, "x\n"), rows[3], rows[3]]
    rng.shuffle(rows)
    got, folder = query(rows)
    assert got == _expected(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    by_sql = con.execute(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({queries.ORACLE_SQL['op11_merkle_manifest']})").fetchall()
    assert sorted(by_sql, key=repr) == got


@pytest.mark.parametrize("rows", [[], [(7, "s", None, 0, "a\n")], [(7, None, None, None, None), (7, None, None, None, None)], [(n, f"s{n}", "en", 1, "t") for n in range(200)]])
def test_small_tables(query, rows):
    assert query(rows)[0] == _expected(rows)


def test_a_changed_sibling_does_not_verify(spark):
    rows = [(n, "s", H(str(n))) for n in range(100)]
    p = merkle.proofs(spark.createDataFrame(rows, "k long, g string, h string"), ["k"], ["k"])
    bad = p.withColumn("path", F.transform("path", lambda s, i: F.when(i == 1, F.struct(F.concat(s["left"], F.lit("0")).alias("left"), s["right"].alias("right"))).otherwise(s)))
    assert p.where(merkle.fold(F.col("h"), "path") == F.col("root")).count() == 100
    assert bad.where(merkle.fold(F.col("h"), "path") == F.col("root")).count() == 0
