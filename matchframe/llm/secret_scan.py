"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Three patterns give the base spans. Beyond them every run of 20 or more key characters is a
candidate: its encoding is inferred, and three tests ask whether it looks like random symbols
of that alphabet - chi-squared uniformity, runs about the middle of the alphabet, and lag-one
serial correlation. Their joint statistic gives the probability p of a random string at least
as uneven. Long words that hold letters only serve as decoys: per length class the lowest p is
chosen at which the expected number of natural strings among the accepted ones stays below
the false-discovery rate, so short strings, which prove less, need a higher p. Decoys of the
shorter classes count for the longer ones, as longer natural strings pass less often. To those
of the table come fixed ones, run-together words of four languages, as many in every class and
for it alone: a small table, whose prose holds few long words, can accept strings as well.

A text stays in its row: one table of span arrays is written, counts of (class, bin of p) give
the thresholds, and nothing else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import let, materialize, query, read, running, unused, whole_text

# fixed values: the kinds, their patterns, and the least length of the named group
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
METHOD = "random"
KEY_RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
LENGTH_CLASSES = (20, 24, 32, 48)
DISCOVERY_RATE, LEAST_P, BINS = 0.05, 1e-3, 64
MADE = 244               # fixed decoys of a length class: four steps through the words from each of them
NATURAL = ("about after because before between children country different during enough every family government house "
           "important little morning number other people aber arbeit beispiel dieser einfach fragen freund gegen haus immer "
           "jahre leben menschen nicht wasser zwischen alors aujourd beaucoup chaque depuis enfant femme grand homme jamais "
           "maison monde pourquoi toujours vraiment ahora amigo camino ciudad desde entonces gente hombre mientras mundo").split()
MASK = "[SECRET]"
SPAN = "array<struct<start:int,kind:int,end:int>>"
CANDIDATE = "array<struct<start:int,end:int,class:int,decoy:boolean,p:double>>"


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>>: leftmost non-overlapping matches with their code
    points; those whose group is shorter than least are dropped after matching."""
    p = F.lit(pattern)
    whole, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    part = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))

    def placed(m, g, v):
        steps = F.flatten(F.transform(m, lambda x, i: F.array(F.length(F.get(g, i)), F.length(x))))
        return let(running(steps, F.lit(0), lambda a, b: a + b), lambda e: F.filter(
            F.transform(v, lambda x, i: F.struct(F.get(e, 2 * i + 1).alias("start"), F.get(e, 2 * i + 2).alias("end"), x.alias("value"))),
            lambda s: F.length(s["value"]) >= least))
    return let(whole, lambda m: let(gaps, lambda g: let(part, lambda v: placed(m, g, v))))


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """The spans of the three patterns: start, kind (position in BASE), end."""
    found = []
    for kind, (name, pattern, group, least) in enumerate(BASE):
        # a text that can't hold a long enough match isn't taken apart
        may = {"assign": text.rlike(pattern), "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike(r"[0-9a-f]{32}")}[name]
        tight = r"[0-9a-f]{32,}" if name == "hex" else pattern
        found.append(F.when(may, _of_kind(matches(text, tight, group, least), kind)).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*found))


def _normal_tail(z: Column) -> Column:
    """P(|N(0, 1)| > z) for z >= 0, by a rational approximation with an error below 2e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * z / F.sqrt(F.lit(2.0)))
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(c)
    return poly * t * F.exp(-z * z / 2)


def randomness(value: Column) -> Column:
    """p of a random string of the inferred encoding being at least as uneven as this one."""
    body = F.regexp_replace(value, "=+$", "")
    alphabet = F.lit(ALPHABETS[-1][1])
    for test, symbols in reversed(ALPHABETS[:-1]):
        alphabet = F.when(body.rlike(test), F.lit(symbols)).otherwise(alphabet)

    def codes(b, a):
        chars = F.filter(F.split(b, ""), lambda c: c != "")
        return F.transform(chars, lambda c: F.instr(a, c).cast("double"))

    def joint(x, size):
        n = F.size(x).cast("double")
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y)
        squares = total(F.transform(F.array_distinct(x), lambda c: F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0))))
        chi, df = squares * size / n - n, size - 1
        wide = 2 / (9 * df)
        z_chi = F.greatest(F.lit(0.0), (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - wide)) / F.sqrt(wide))
        upper = total(F.transform(x, lambda y: (y > size / 2).cast("double")))
        runs = 1 + total(F.transform(x, lambda y, i: ((i > 0) & ((y > size / 2) != (F.get(x, i - 1) > size / 2))).cast("double")))
        mean_runs = 2 * upper * (n - upper) / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, (runs - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(6.0))
        mean = total(x) / n

        def serial(m):
            spread = total(F.transform(x, lambda y: (y - m) * (y - m)))
            lagged = total(F.transform(x, lambda y, i: F.when(i > 0, (y - m) * (F.get(x, i - 1) - m)).otherwise(F.lit(0.0))))
            return let(spread, lambda s: F.when(s > 0, lagged / s * F.sqrt(n)).otherwise(F.lit(6.0)))
        z_serial = let(mean, serial)
        return let(z_chi * z_chi + z_runs * z_runs + z_serial * z_serial, lambda t: F.least(F.lit(1.0), _normal_tail(F.sqrt(t)) + F.sqrt(2 * t / F.lit(3.141592653589793)) * F.exp(-t / 2)))
    return let(alphabet, lambda a: let(codes(body, a), lambda x: joint(x, F.length(a).cast("double"))))


def candidates(text: Column) -> Column:
    """Key-like runs with their length class, whether they are decoys, and p."""
    def judged(s):
        v, n = s["value"], F.length(s["value"])
        kind = sum(((n >= F.lit(c)).cast("int") for c in LENGTH_CLASSES[1:]), F.lit(0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("class"), v.rlike("^[A-Za-z]+$").alias("decoy"), randomness(v).alias("p"))
    worth = lambda s: s["value"].rlike("[A-Za-z]") & (s["value"].rlike("[0-9]") | s["value"].rlike("^[A-Za-z]+$"))
    found = F.transform(F.filter(matches(text, KEY_RUN), worth), judged)
    return F.when(text.rlike(KEY_RUN), found).otherwise(F.array().cast(CANDIDATE))


def made_decoys() -> list[tuple[int, str]]:
    """(length class, string): MADE run-together words of every class, half of them with capitals."""
    out = []
    for c, (low, high) in enumerate(zip(LENGTH_CLASSES, (*LENGTH_CLASSES[1:], 64))):
        for k in range(MADE):
            start, step = k % len(NATURAL), 1 + k // len(NATURAL)
            words = [NATURAL[(start + j * step) % len(NATURAL)] for j in range(high)]
            out.append((c, "".join(w.capitalize() if k % 2 else w for w in words)[:low + k % (high - low)]))
    return out


def thresholds(found: DataFrame, column: str = "candidates") -> list[float]:
    """The least p per length class that keeps the false-discovery rate; 2.0 where none does.
    Counts per class and bin, at most 512 rows, are all that is gathered."""
    made = found.sparkSession.createDataFrame(made_decoys(), "class int, value string").select("class", F.lit(False).alias("decoy"), randomness(F.col("value")).alias("p"), F.lit(True).alias("made"))
    one = found.select(F.explode(column).alias("c")).select("c.class", "c.decoy", "c.p", F.lit(False).alias("made")).unionByName(made)
    bins = one.groupBy("class", F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int").alias("bin")).agg(
        F.sum(F.col("decoy").cast("long")).alias("decoys"), F.sum((~F.col("decoy") & ~F.col("made")).cast("long")).alias("targets"), F.sum(F.col("made").cast("long")).alias("fixed"))
    above = Window.partitionBy("class").orderBy(F.desc("bin"))
    whole = Window.partitionBy("class")
    rows = bins.select("class", "bin", F.sum("decoys").over(above).alias("d"), F.sum("targets").over(above).alias("t"), F.sum("fixed").over(above).alias("f"),
                       F.sum("decoys").over(whole).alias("all_d"), F.sum("targets").over(whole).alias("all_t")).collect()
    out = []
    for k in range(len(LENGTH_CLASSES)):
        all_d = sum(max((r.all_d for r in rows if r["class"] == j), default=0) for j in range(k + 1)) + MADE
        all_t = max((r.all_t for r in rows if r["class"] == k), default=0)
        best = 2.0
        for r in sorted((r for r in rows if r["class"] == k and r.t), key=lambda r: -r.bin):
            passed = sum(max((s.d for s in rows if s["class"] == j and s.bin >= r.bin), default=0) for j in range(k + 1)) + r.f
            if (passed + 1) / (all_d + 1) * all_t / r.t <= DISCOVERY_RATE:
                best = max(LEAST_P, r.bin / BINS)
        out.append(best)
    return out


def all_spans(base: Column, found: Column, least: list[float]) -> Column:
    """Base spans and the accepted candidates that overlap none of them, by start and kind."""
    limit = lambda c: F.element_at(F.array(*map(F.lit, least)), c["class"] + 1)
    taken = F.filter(found, lambda c: ~c["decoy"] & (c["p"] >= limit(c)))
    spans = F.array_sort(F.concat(base, F.transform(taken, lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("kind"), c["end"].alias("end")))))
    own, far = lambda s: s["kind"] < len(BASE), F.lit(2147483647)

    def apart(sp):
        # the farthest end of the base spans before each span, and the nearest start of those after it
        before = running(F.transform(sp, lambda s: F.when(own(s), s["end"]).otherwise(F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b))
        after = running(F.reverse(F.transform(sp, lambda s: F.when(own(s), s["start"]).otherwise(far))), far, lambda a, b: F.least(a, b))
        return let(before, lambda e: let(after, lambda b: F.filter(
            sp, lambda s, i: own(s) | ((F.get(e, i) <= s["start"]) & (F.get(b, F.size(sp) - 1 - i) >= s["end"])))))
    return F.when(F.size(taken) == 0, base).otherwise(let(spans, apart))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*[b[0] for b in BASE], METHOD)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base, spans (arrays of start, kind, end) for every row. Null and empty texts hold
    none; repeated rows and null ids come out as they went in; other columns are left behind."""
    taken = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    found = materialize(taken.select(id_col, base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("candidates")))
    return found.select(id_col, "base", all_spans(F.col("base"), F.col("candidates"), thresholds(found)).alias("spans"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns; every found span of the text is replaced by a mark, and n_chars
    follows where there is such a column. Texts without secrets, null ones too, stay as they are."""
    found = materialize(docs.select(candidates(whole_text()).alias("candidates")))
    least = thresholds(found)
    text, (base, spans) = whole_text(), unused(docs, "base", "spans")
    marked = docs.withColumn(base, base_spans(text)).withColumn(spans, all_spans(F.col(base), candidates(text), least))

    def replaced(sp):
        def joined(pos):  # where the text before each span, and the rest of it, begins
            parts = F.transform(sp, lambda s, i: F.when(s["start"] >= F.get(pos, i), F.concat(F.substring(text, F.get(pos, i) + 1, s["start"] - F.get(pos, i)), F.lit(MASK))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(pos, -1) + 1, F.lit(2147483647)))
        return let(running(F.transform(sp, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), joined)
    out = marked.withColumn("text", F.when(F.size(spans) == 0, F.col("text")).otherwise(replaced(F.col(spans))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


@query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    """Counts and spans of secrets in every document."""
    marked = scan(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return marked.select("doc_id", *[count(k).alias(f"n_{b[0]}") for k, b in enumerate(BASE)],
                         F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
