"""The secret scan of whole texts against regular expressions and entropies taken window by window."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

from spliceflow.llm import queries
from spliceflow.llm import secret_scan as S
from spliceflow.llm.common import documents


ALNUM = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"


def slug(run):
    """Parts of up to 16 characters, each followed by one separator but perhaps the last, behind a slash or not."""
    parts = re.split("[/_-]", run.removeprefix("/"))
    return len(parts) > 1 and all(re.fullmatch("[a-z0-9.]{1,16}", p) for p in parts[:-1]) and bool(re.fullmatch("[a-z0-9.]{0,16}", parts[-1]))


def brute_force(text):
    """(base, all) spans as (start, kind number, end)."""
    base = []
    for kind, (_, pattern, group, least) in enumerate(S.BASE_KINDS):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern.replace("((?i:", "(?i:(").replace("|api_?key))", "|api_?key))"), text) if len(m.group(2 if group else 0)) >= least]
    base.sort()
    more = []
    for m in re.finditer(S.CANDIDATE, text):
        run = m.group()
        if any(re.search(p, run) for p in S.ALLOW) or slug(run):
            continue
        least = next((t for _, p, t in S.CLASSES if re.search(p, run)), None)
        windows = [Counter(run[i : i + S.WINDOW]) for i in range(len(run) - S.WINDOW + 1)]
        best = max(-sum(c / S.WINDOW * math.log2(c / S.WINDOW) for c in w.values()) for w in windows)
        if least is not None and best >= least - 1e-12 and not any(a < m.end() and m.start() < b for a, _, b in base):
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def written(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_scan_equals_brute_force(spark, data):
    rng = np.random.default_rng(3)
    some = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    odd = [f"é {some(ALNUM, 30)} TOKEN : '{some('aZ0+/', 12)}' {some('0123456789abcdef', 40)} AKIA{some('ABC019', 14)} {some(ALNUM + '-_=/', 24)} {some('xy', 4) * 9}" for _ in range(60)]
    odd += ["password=short", "api_key=" + "a" * 12 + " secret:" + "b" * 11, "AKIA" * 9, "your-api-key-placeholder-1234 example_example_example", "0123456789abcdefghijklmnop", "=" * 40, ""]
    rows = [(r.doc_id, r.text) for r in documents(spark, data).select("doc_id", "text").collect()] + [(10**6 + k, t) for k, t in enumerate(odd)]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", S.written("base_spans").alias("base"), S.written("spans").alias("spans")).collect()}
    found = 0
    for i, t in rows:
        base, every = brute_force(t or "")
        assert got[i].base == written(base), i
        assert got[i].spans == written(every), i
        found += len(every) - len(base)
    assert found > 50


def test_query_columns(spark, data):
    text = {r.doc_id: r.text or "" for r in documents(spark, data).collect()}
    for r in queries.op8_secret_scan(spark, data).collect():
        base, every = brute_force(text[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest() and r.spans == written(every)


def test_slugs_and_paths(spark):
    rng = np.random.default_rng(4)
    runs = ["".join(rng.choice(list("a0/_-b"), rng.integers(20, 40))) for _ in range(300)]
    runs += ["-".join("".join(rng.choice(list("ab01"), rng.integers(0, 19))) for _ in range(4)) + e for _ in range(200) for e in ("", "/", "a")]
    runs += ["/abcdefghij0123456789", "/ab/cdefghij0123456789", "_ab/cd/ef/gh/ij/kl/mn/op"]
    runs = [r for r in runs if len(r) >= S.WINDOW]
    must, never = S.PATH
    from pyspark.sql import functions as F

    d = spark.createDataFrame(list(enumerate(runs)), "k int, r string")
    ok = F.lit(True)
    for p in must:
        ok = ok & F.col("r").rlike(p)
    for p in never:
        ok = ok & ~F.col("r").rlike(p)
    got = {r.k: r.ok for r in d.select("k", ok.alias("ok")).collect()}
    want = {k: slug(r) for k, r in enumerate(runs)}
    assert got == want and 20 < sum(want.values()) < len(runs) - 20


def test_runs_of_a_megabyte(spark):
    """Runs of any length are scanned and redacted in linear time, without Java's stack."""
    rng = np.random.default_rng(5)
    n = 1 << 20
    key = "".join(rng.choice(list(ALNUM + "+/"), n))
    odd = ["abc/" * (n // 4), "aB-" * (n // 3), "-" * n, key, "abcdefghijklm" + "a" * n + "=", "0123456789" * (n // 10), "xy" * (n // 2) + "!", "0123456789abcdefghij-" * (n // 21), "a1B2" * (n // 4)]
    rows = [(k, f"x {t} y") for k, t in enumerate(odd)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in S.scan(d).select("doc_id", S.written("spans").alias("spans")).collect()}
    assert got[3] == f"entropy:2:{n + 2}"
    assert all(not got[k] for k in (0, 1, 2, 6, 8)) and got[5].startswith("hex:")
    clean = {r.doc_id: r.text for r in S.redact(d).collect()}
    assert clean[3] == "x [SECRET] y" and clean[0] == rows[0][1]
