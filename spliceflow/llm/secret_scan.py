"""Secret scanning with DataFrame functions only.

Three fixed kinds of matches (assignments to secret-like names, access key ids, hex runs) are found by regular expressions;
further candidates, long runs of key characters, are kept by their entropy: a window slides over the run, its character counts
are updated by the one that enters and the one that leaves, and the largest Shannon entropy of any window must reach the
threshold of the run's character class (hex, alphanumeric, base64). Runs on the allow-list (words and slugs, paths, UUIDs,
alphabets, placeholders) are suppressed, as are runs inside a span already found.

Spans are (start, kind, end) in code points, end exclusive, ordered by start and then kind in the order of KINDS.
Defined cases: null text counts as empty and has no spans; equal texts have equal spans; extra columns are kept, ones with the names of
results replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which equal starts are listed, with pattern, capture group whose length counts, least length.
BASE_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
ENTROPY_KIND = "entropy"
KINDS = [*(k for k, *_ in BASE_KINDS), ENTROPY_KIND]
WINDOW = 20
#: Matches of a text that are placed at a time.
PART = 512
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character class, pattern of the whole run, least entropy of its best window (20 characters have at most 4.32 bits).
CLASSES = [("hex", r"^([0-9A-F]+|[0-9a-f]+)$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8)]
#: Runs that are no secrets however mixed they are. No pattern repeats a group without bound: Java's would call itself for each turn, and a
#: long run would end the program.
ALLOW = [
    r"^[A-Za-z_/=+-]+$", r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)^[a-z0-9]{0,8}[_-]?(abcdefghijklm[a-z]*+|0?123456789[0-9]*+|example|placeholder|changeme|your)([_-]?[a-z]{0,12}){0,4}[0-9]{0,4}$", r"^(.{1,4})\1{3,}.{0,3}$",
]
#: Paths and slugs: single separators between parts of up to 16 characters, given as what must and what must not be found.
PATH = [r"^[a-z0-9./_-]+$", r"[a-z0-9.][/_-]"], [r"^[_-]", r"[/_-]{2}", r"[a-z0-9.]{17}"]


def _placed(text: Column, pattern: str, found: Column, kept: Column, kind: int, group: Column | None = None) -> Column:
    """Spans of the matches `found` of the pattern, placed by the pieces of text between them; kept: (match, group) -> condition."""
    rest = F.split(text, pattern, -1)
    groups = found if group is None else group
    steps = F.zip_with(F.slice(rest, 1, F.size(found)), F.arrays_zip(found.alias("m"), groups.alias("g")), lambda p, x: F.struct(F.length(p).alias("gap"), x["m"].alias("m"), x["g"].alias("g")))
    span = lambda s, e: F.array(F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    size = lambda x: F.length(x["m"])

    def walk(part: Column, at: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(at.alias("at"), none.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + size(x)).alias("at"),
                F.when(kept(x["m"], x["g"]), F.concat(a["out"], span(a["at"] + x["gap"], a["at"] + x["gap"] + size(x)))).otherwise(a["out"]).alias("out"),
            ),
        )

    # in parts of PART matches, so that texts of many matches do not copy all spans for each
    numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PART).cast("int"))
    walked = F.aggregate(
        F.transform(numbers, lambda n: F.slice(steps, n * PART + 1, PART)),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, part: (lambda w: F.struct(w["at"].alias("at"), F.concat(a["out"], w["out"]).alias("out")))(walk(part, a["at"])),
        lambda a: a["out"],
    )
    return F.when(F.size(found) > 0, walked).otherwise(none)


def _best_entropy(run: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, over all windows of the run. The state is the window's text, from which the count of the character
    that enters and of the one that leaves are read, and the sum of c * log2 c, which these two counts change."""
    f = lambda c: F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))

    def step(a: Column, new: Column) -> Column:
        full = F.length(a["text"]) == window
        old = F.substring(a["text"], F.lit(1), F.lit(1))
        d = count(a["text"], old)
        s1 = F.when(full, a["s"] + f(d - 1) - f(d)).otherwise(a["s"])
        kept = F.when(full, F.substring(a["text"], F.lit(2), F.lit(window))).otherwise(a["text"])
        c = count(kept, new)
        s2 = s1 + f(c + 1) - f(c)
        best = F.when(F.length(kept) >= window - 1, F.greatest(a["best"], F.log2(F.lit(float(window))) - s2 / window)).otherwise(a["best"])
        return F.struct(F.concat(kept, new).alias("text"), s2.alias("s"), best.alias("best"))

    start = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.aggregate(F.split(run, ""), start, step, lambda a: a["best"])


def _suspicious(run: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | run.rlike(pattern)
    must, never = PATH
    slug = run.rlike(must[0]) & run.rlike(must[1])
    for pattern in never:
        slug = slug & ~run.rlike(pattern)
    least = F.lit(None).cast("double")
    for _, pattern, threshold in reversed(CLASSES):
        least = F.when(run.rlike(pattern), F.lit(threshold)).otherwise(least)
    return F.when(allowed | slug, F.lit(False)).otherwise(F.coalesce(_best_entropy(run) >= least, F.lit(False)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans and spans (the base ones and those found by entropy): arrays of (start, kind number, end)."""
    names = [c for c in docs.columns if c not in ("base_spans", "spans")]
    d = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    t = F.col("__t")
    (k1, p1, g1, n1), (k2, p2, _, n2), (k3, p3, _, n3) = BASE_KINDS
    d = d.withColumns({
        "__assign": F.regexp_extract_all(t, F.lit(p1), F.lit(0)),
        # with the least length in the pattern a run matches in the same place, as every character of a run belongs to it
        "__access": F.regexp_extract_all(t, F.lit(rf"AKIA[A-Z0-9]{{{n2 - 4},}}"), F.lit(0)),
        "__hex": F.regexp_extract_all(t, F.lit(rf"[0-9a-f]{{{n3},}}"), F.lit(0)),
        "__runs": F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)),
    })
    yes = lambda m, g: F.lit(True)
    groups = F.when(F.size("__assign") > 0, F.regexp_extract_all(t, F.lit(p1), F.lit(g1)))
    base = F.concat(
        _placed(t, p1, F.col("__assign"), lambda m, g: F.length(g) >= n1, 0, groups),
        _placed(t, rf"AKIA[A-Z0-9]{{{n2 - 4},}}", F.col("__access"), yes, 1),
        _placed(t, rf"[0-9a-f]{{{n3},}}", F.col("__hex"), yes, 2),
    )
    d = d.withColumn("base_spans", F.array_sort(base))
    d = d.withColumn("__more", _placed(t, CANDIDATE, F.col("__runs"), lambda m, g: _suspicious(m), 3))
    outside = F.filter("__more", lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return d.select(*names, "base_spans", F.when(F.size("__more") > 0, F.array_sort(F.concat("base_spans", outside))).otherwise(F.col("base_spans")).alias("spans"))


def written(spans: Column | str) -> Column:
    """kind:start:end of the spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by the marker (overlapping spans by one); null texts stay null."""
    names = docs.columns
    d = scan(docs, text)
    t = F.col(text)
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(t, a["at"] + 1, x["start"] - a["at"]), F.lit(marker))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    return d.withColumn(text, F.when(F.size("spans") > 0, cut).otherwise(t)).select(*names)
