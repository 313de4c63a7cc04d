"""Secret scan: fixed patterns, and a randomness test battery for what they miss; DataFrame functions only.

Base spans are the matches of three patterns. Beyond them, every token of `MIN_TOKEN` or more characters of the
base64 family gets an inferred encoding and three tests: chi-squared uniformity over that alphabet, runs above
and below the alphabet's middle, and lag-1 serial correlation, joined into one p-value of "looks uniformly
random". The false finds to control are structured tokens: words, names, paths, numbers. Their null is a fixed
character model (letter frequencies, runs of one class of characters), so no decoys are needed in the table: the
likelihood of a token under its uniform alphabet over that under the model is an e-value, whose mean is at most 1
for what follows the model. The e-values of all tokens go through the e-BH rule, which holds the expected
share of false finds under `fdr` whatever the dependence. Counts cover all rows; only the cut-off is broadcast.

A token is a run of the family's characters with up to two signs of padding; `=` before it ends another token, so what
follows `key=` is tested by itself. Limits: tokens under `MIN_TOKEN` characters, and what is joined to other text by a
character of the family (`/`, `-`, `_`, `+`), are not tested by themselves; digits alone are as likely under the model as at random,
and random words of one letter case take more characters to stand out than mixed ones.

Defined results: NULL or empty text has no spans (the digest of the empty list); equal rows get equal spans; a
NULL id is kept. Spans cost time in proportion to a text's length, however many it holds.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import let, read, stash

#: The patterns of the base kinds, in the order in which ties are listed.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
MIN_TOKEN = 20
TOKEN, PADDING = r"[A-Za-z0-9+/_-]{20,}", "={0,2}"
#: Alphabets of encodings, from the narrowest; a token gets the first that holds all its characters.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": LOWER.upper() + "234567",
    "base36": DIGITS + LOWER,
    "base62": DIGITS + LOWER.upper() + LOWER,
    "base64": LOWER.upper() + LOWER + DIGITS + "+/-_",
}
#: Letters alone have alphabets of their own, before the others.
INFERRED = {"lower": LOWER, "upper": LOWER.upper()} | {k: ALPHABETS[k] for k in ("hex", "HEX", "base32", "base36")} | {"letters": LOWER.upper() + LOWER} | {k: ALPHABETS[k] for k in ("base62", "base64")}
#: The model of structured tokens. Rounded percent of letters a to z in western European prose; the chance
#: of each class (upper, lower, digit, other) after each.
LETTERS = (7.8, 1.5, 3.0, 4.2, 13.5, 1.6, 1.8, 3.5, 7.3, 0.4, 0.7, 4.2, 2.6, 7.6, 6.1, 2.3, 0.4, 6.6, 6.8, 7.4, 3.6, 1.2, 1.2, 0.4, 1.2, 0.7)
AFTER = ((0.50, 0.44, 0.03, 0.03), (0.06, 0.86, 0.04, 0.04), (0.05, 0.05, 0.80, 0.10), (0.20, 0.50, 0.20, 0.10))
BINS = 100
SUMS = 256
#: What a text must hold for a pattern to match at all; spares most texts the pattern.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "hex": ()}


def greedy(run: str) -> str:
    """The same matches of a run pattern [..]{n,}, without trying again inside a run that is too short."""
    return f"(?<!{run[: run.index(']') + 1]}){run}+"


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:int,token:string>>")


def running_sums(x: Column) -> Column:
    """Running sums of an array of integers, in blocks, so that a long array costs no more than `SUMS` steps an entry."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / SUMS).cast("int")), lambda b: total(F.slice(x, b * SUMS + 1, F.lit(SUMS))))
    before = lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b)))
    own = lambda i: total(F.slice(x, i - i % SUMS + 1, i % SUMS + 1))
    return let(let(blocks, before), lambda t: F.transform(x, lambda _, i: F.get(t, F.floor(i / SUMS).cast("int")) + own(i)))


def found_spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans (start, end, kind, token) of a pattern's matches, in code points. What lies between matches gives
    their places. least: characters that group 1 needs."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else whole
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("w"), inner.alias("g"), F.slice(gaps, 1, F.size(whole)).alias("b"))

    def spans(m: Column) -> Column:
        """m: the matches and the end of each."""
        one = lambda x, i: F.struct((F.get(m["ends"], i) - F.length(x["w"])).alias("start"), F.get(m["ends"], i).alias("end"), F.lit(kind).alias("kind"), x["w"].alias("token"))
        every = F.transform(m["z"], lambda x, i: F.struct(one(x, i).alias("s"), F.length(x["g"]).alias("g")))
        return F.transform(F.filter(every, lambda x: x["g"] >= least), lambda x: x["s"])

    ends = lambda z: let(F.transform(z, lambda x: F.length(x["b"]) + F.length(x["w"])), running_sums)
    found = let(zipped, lambda z: let(F.struct(z.alias("z"), ends(z).alias("ends")), spans))
    return F.when(F.size(whole) > 0, found).otherwise(no_spans())


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, _t (hash of the text), base spans, token spans. One pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    holds = lambda kind: functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in NEEDS[kind]], F.lit(not NEEDS[kind]))
    quick = PATTERNS | {"hex": greedy(PATTERNS["hex"])}
    base = [F.when(holds(kind), found_spans(text, p, k, 8 if kind == "assign" else 0)).otherwise(no_spans()) for k, (kind, p) in enumerate(quick.items())]
    no_token = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return docs.select("doc_id", F.xxhash64(text).alias("_t"), F.sort_array(no_token(F.concat(*base))).alias("base"), found_spans(text, greedy(TOKEN) + PADDING, len(PATTERNS)).alias("tokens"))


def infer(tokens: DataFrame) -> DataFrame:
    """Adds bare (no padding), alphabet and n. Every token with an alphabet is tested."""
    bare = F.rtrim(F.col("token"), F.lit("="))
    alphabet = F.lit(None).cast("string")
    for letters in reversed(list(INFERRED.values())):
        alphabet = F.when(F.translate("bare", letters, "") == "", F.lit(letters)).otherwise(alphabet)
    out = tokens.withColumn("bare", bare).withColumn("alphabet", alphabet).where("alphabet IS NOT NULL")
    return out.withColumn("n", F.length("bare").cast("double")).where(F.col("n") >= MIN_TOKEN)


#: -log of the model's chance of each sign of ALPHABETS["base64"], and of each step from class to class.
_SHARE = [x / sum(LETTERS) for x in LETTERS]
COSTS = [-math.log(x) for x in _SHARE + _SHARE + [0.1] * 10 + [0.25] * 4]
STEPS = [-math.log(x) for row in AFTER for x in row]


def evidence(tokens: DataFrame) -> DataFrame:
    """Adds e: log of the token's likelihood over its alphabet at random, over that under the model."""
    signs = ALPHABETS["base64"]
    costs, steps = F.array(*map(F.lit, COSTS)), F.array(*map(F.lit, STEPS))
    at = F.transform(F.filter(F.split("bare", ""), lambda c: c != ""), lambda c: F.instr(F.lit(signs), c))
    kind = lambda v: F.when(v <= 26, 0).when(v <= 52, 1).when(v <= 62, 2).otherwise(3)
    t = tokens.withColumn("at", at).withColumn("kinds", F.transform("at", kind))
    t = t.withColumn("moves", F.zip_with(F.slice("kinds", 1, F.size("kinds") - 1), F.slice("kinds", 2, F.size("kinds") - 1), lambda a, b: 4 * a + b))
    total = lambda arr, of: F.aggregate(arr, F.lit(0.0), lambda s, v: s + F.get(of, v))
    model = total(F.transform("at", lambda v: v - 1), costs) + total(F.col("moves"), steps) + math.log(4)
    return t.withColumn("e", model - F.col("n") * F.log(F.length("alphabet").cast("double"))).drop("at", "kinds", "moves")


def battery(tokens: DataFrame) -> DataFrame:
    """Adds p: how well a token passes for uniformly random over its alphabet, by the three tests together."""
    n, a = F.col("n"), F.length("alphabet").cast("double")
    x = F.col("x")
    square = lambda c: c * c
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    t = tokens.withColumn("x", F.transform(F.filter(F.split("bare", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    t = t.withColumn("squares", total(F.transform(F.array_distinct(x), lambda v: square(F.size(F.filter(x, lambda y: y == v)).cast("double")))))
    df = a - 1
    chi2 = a / n * F.col("squares") - n
    t = t.withColumn("z1", (F.cbrt(chi2 / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    t = t.withColumn("above", F.transform(x, lambda v: F.when(v > a / 2, 1.0).otherwise(0.0))).withColumn("n1", total(F.col("above")))
    pairs = lambda arr: F.arrays_zip(F.slice(arr, 1, F.size(arr) - 1).alias("p"), F.slice(arr, 2, F.size(arr) - 1).alias("q"))
    t = t.withColumn("runs", 1 + total(F.transform(pairs(F.col("above")), lambda v: F.when(v["p"] != v["q"], 1.0).otherwise(0.0))))
    twice = 2 * F.col("n1") * (n - F.col("n1"))
    spread = twice * (twice - n) / (n * n * (n - 1))
    t = t.withColumn("z2", F.when(spread > 0, (F.col("runs") - twice / n - 1) / F.sqrt(spread)).otherwise(F.sqrt(n)))
    t = t.withColumn("mean", total(x) / n)
    centred = lambda v: v - F.col("mean")
    var = total(F.transform(x, lambda v: square(centred(v))))
    cov = total(F.transform(pairs(x), lambda v: centred(v["p"]) * centred(v["q"])))
    t = t.withColumn("z3", F.when(var > 0, (cov / var + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n)))
    d = square(F.greatest(F.col("z1"), F.lit(0.0))) + square(F.col("z2")) + square(F.col("z3"))
    u = (F.cbrt(d / 3) - (1 - 2 / 27)) / (2 / 27) ** 0.5
    return t.withColumn("p", 1 / (1 + F.exp(F.least(F.lit(60.0), 1.5976 * u + 0.07056 * u * u * u))))


def cut_off(tested: DataFrame, fdr: float) -> DataFrame:
    """least: the least whole e at which the e-BH rule holds, from counts over all tokens; one row, NULL if none.
    Values are rounded down to whole e and bounded, so there are at most 301 bins."""
    counts = tested.groupBy("bin").agg(F.count("*").alias("c"))
    down = counts.withColumn("k", F.sum("c").over(W.orderBy(F.desc("bin")))).withColumn("m", F.sum("c").over(W.partitionBy()))
    holds = F.col("bin") + F.log(F.col("k").cast("double")) >= F.log(F.col("m") / fdr)
    return down.agg(F.min(F.when(holds, F.col("bin"))).alias("least"))


def clear_of_base(found: DataFrame, scanned: DataFrame) -> DataFrame:
    """The found spans that no base span of their text overlaps: in the order of places, a span is overlapped if a base
    span that starts before its end reaches past its start."""
    row = ["doc_id", "_t"]
    texts = found.select(*[F.col(c).alias(f"_{c}") for c in row]).distinct()
    own = scanned.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_t") == F.col("__t")), "left_semi")
    base = own.select(*row, F.explode("base").alias("s")).select(*row, F.col("s.start").alias("_at"), F.lit(1).alias("_base"), "s.start", "s.end", "s.kind")
    both = found.select(*row, F.col("end").alias("_at"), F.lit(0).alias("_base"), "start", "end", "kind").unionByName(base)
    before = W.partitionBy(*row).orderBy("_at", "_base").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("_base") == 1, F.col("end"))).over(before)
    return both.withColumn("_reach", reach).where((F.col("_base") == 0) & (F.coalesce("_reach", F.lit(0)) <= F.col("start"))).select(*row, "start", "end", "kind")


def secret_spans(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind); kind is a place in PATTERNS, or one past
    it for spans that the battery adds where no base span lies."""
    scanned = stash(scan(docs), "secret-scan")
    tokens = scanned.where(F.size("tokens") > 0).select("doc_id", "_t", F.explode("tokens").alias("s"))
    tested = evidence(battery(infer(tokens.select("doc_id", "_t", "s.*"))))
    bin_ = F.floor(F.least(F.greatest("e", F.lit(0.0)), F.lit(300.0))).cast("int").alias("bin")
    tested = stash(tested.select("doc_id", "_t", "start", "end", "kind", "p", bin_), "secret-tests")
    cut = cut_off(tested, fdr)
    random = tested.where(F.col("p") * BINS >= 1).join(F.broadcast(cut), F.col("bin") >= F.col("least")).select("doc_id", "_t", "start", "end", "kind")
    added = clear_of_base(stash(random, "secret-finds"), scanned).groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_u")).agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))
    both = scanned.join(added, scanned["doc_id"].eqNullSafe(added["_d"]) & (scanned["_t"] == added["_u"]), "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    by_start = F.transform(F.concat("base", F.coalesce("added", none)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return both.select("doc_id", "base", F.sort_array(by_start).alias("spans"))


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*PATTERNS, "random")])
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(by_start, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secret_spans(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == list(PATTERNS).index(kind))).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _places(pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """SQL: the spans of a pattern in `text`, as structs."""
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(generate_series(1, len(regexp_extract_all(text, '{p}'))), lambda i: {{
      'start': list_sum([0] || list_transform(string_split_regex(text, '{p}')[1:i], lambda g: length(g)))::INT + list_sum([0] || list_transform(regexp_extract_all(text, '{p}')[1:i-1], lambda g: length(g)))::INT,
      'kind': {kind}, 'token': regexp_extract_all(text, '{p}')[i], 'inner': regexp_extract_all(text, '{p}', {group})[i]}}), lambda s: length(s.inner) >= {least})"""


_KINDS = "['assign', 'access', 'hex', 'random']"
_ALPHABET = "CASE " + " ".join(f"WHEN translate(bare, '{a}', '') = '' THEN '{a}'" for a in INFERRED.values()) + " END"
_COSTS, _STEPS = (f"[{', '.join(f'{x!r}::DOUBLE' for x in xs)}]" for xs in (COSTS, STEPS))
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, unnest(list_concat({_places(PATTERNS["assign"], 0, 1, 8)}, list_concat({_places(PATTERNS["access"], 1)}, {_places(PATTERNS["hex"], 2)}))) AS s FROM d
), base AS (SELECT doc_id, s.start AS a, s.start + length(s.token) AS z, s.kind AS kind FROM b),
t0 AS (SELECT doc_id, unnest({_places(TOKEN + PADDING, 3)}) AS s FROM d),
t1 AS (SELECT doc_id, s.start AS a, s.start + length(s.token) AS z, rtrim(s.token, '=') AS bare FROM t0),
t2 AS (SELECT *, {_ALPHABET} AS alphabet, length(bare)::DOUBLE AS n FROM t1 WHERE length(bare) >= {MIN_TOKEN}),
t3 AS (
  SELECT *, length(alphabet)::DOUBLE AS k, list_transform(string_split(bare, ''), lambda c: instr(alphabet, c)::DOUBLE) AS x,
         list_transform(string_split(bare, ''), lambda c: instr('{ALPHABETS["base64"]}', c)) AS signs FROM t2 WHERE alphabet IS NOT NULL
), t4 AS (SELECT *, list_transform(signs, lambda v: CASE WHEN v <= 26 THEN 0 WHEN v <= 52 THEN 1 WHEN v <= 62 THEN 2 ELSE 3 END) AS kinds FROM t3),
t5 AS (
  SELECT *, list_sum(list_transform(signs, lambda v: {_COSTS}[v])) + list_sum(list_transform(generate_series(2, len(kinds)), lambda i: {_STEPS}[4 * kinds[i-1] + kinds[i] + 1])) + ln(4) - n * ln(k) AS e,
         list_sum(list_transform(list_distinct(x), lambda v: len(list_filter(x, lambda y: y = v))::DOUBLE ** 2)) AS squares,
         list_transform(x, lambda v: (v > k / 2)::INT) AS above, list_sum(x) / n AS mean FROM t4
), t6 AS (
  SELECT *, list_sum(above)::DOUBLE AS n1, 1 + list_sum(list_transform(generate_series(2, len(x)), lambda i: (above[i] <> above[i-1])::INT))::DOUBLE AS runs,
         list_sum(list_transform(x, lambda v: (v - mean) ** 2)) AS var,
         list_sum(list_transform(generate_series(2, len(x)), lambda i: (x[i] - mean) * (x[i-1] - mean))) AS cov FROM t5
), t7 AS (
  SELECT *, (cbrt((k / n * squares - n) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z1,
         2 * n1 * (n - n1) AS twice, CASE WHEN var > 0 THEN (cov / var + 1 / n) * sqrt(n) ELSE sqrt(n) END AS z3 FROM t6
), t8 AS (
  SELECT *, CASE WHEN twice * (twice - n) > 0 THEN (runs - twice / n - 1) / sqrt(twice * (twice - n) / (n * n * (n - 1))) ELSE sqrt(n) END AS z2 FROM t7
), u AS (SELECT *, (cbrt((greatest(z1, 0) ** 2 + z2 ** 2 + z3 ** 2) / 3) - (1 - 2.0::DOUBLE / 27)) / sqrt(2.0::DOUBLE / 27) AS u FROM t8),
p AS (SELECT *, 1 / (1 + exp(least(60, 1.5976::DOUBLE * u + 0.07056::DOUBLE * u * u * u))) AS p, floor(least(greatest(e, 0), 300))::INT AS bin FROM u),
c AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin DESC) AS k, sum(count(*)) OVER () AS m FROM p GROUP BY bin),
cut AS (SELECT min(bin) AS least FROM c WHERE bin + ln(k) >= ln(m / 0.05)),
added AS (
  SELECT p.doc_id, p.a, p.z, 3 AS kind FROM p JOIN cut ON p.bin >= cut.least WHERE p.p * {BINS} >= 1
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = p.doc_id AND base.a < p.z AND base.z > p.a)
), one AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
         string_agg({_KINDS}[kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind) AS listed FROM base GROUP BY doc_id
), every AS (
  SELECT doc_id, string_agg({_KINDS}[kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind) AS listed
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(one.listed, '')) AS base_sha256, coalesce(every.listed, '') AS spans
FROM d LEFT JOIN one USING (doc_id) LEFT JOIN every USING (doc_id)
"""
