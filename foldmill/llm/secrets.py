"""Secret scans by character Markov models, in DataFrame functions only.

Fixed patterns give the base spans (assign, access, hex). Besides, every run of 8
or more token characters, with digits or not, is scored outside the base spans: the
log-likelihood of its character pairs under a model of random strings, less that
under a model of ordinary identifiers, less a margin for each pair. A segment whose
sum is over the evidence that its length asks for (more of short ones, none from 20
characters on) is a span of kind ``markov``, whatever stands before or behind it in the run: it begins where the running sum was least, ends at
the sum's peak, and grows to the next separator on both sides (past pieces of up to
four characters), so that a secret's ends aren't cut off; another one begins behind
it. So short segments need a higher ratio for each pair than long ones. Repetitions
of very few characters (separator lines) are none. Both models are counts of
character pairs in labelled samples; pairs seen little or never fall back on how
often their second character occurs (counts with one added), so that a small
sample tells digits and capitals from ordinary letters, too. Only the logs, one
for each pair of a fixed alphabet, come to the driver.

Results by case: null text counts as empty and has no spans; repeated rows give
repeated results; offsets are code points, end exclusive, over the whole text,
however long; of segments that overlap after growing one span is made; with an
empty sample of either kind that model is uniform; an empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.llm._shared import table

#: The base patterns (Java's (?i:) folds ASCII letters only, as wanted).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_BLOCK = 128
#: Character codes of runs are below this.
_CODES = 123
#: How often an ordinary name is in capitals, to one that isn't.
CAPITALS = 0.1
#: What a segment must give, in nats: for each pair, and besides, less a share for each pair until there are LONG.
MARGIN, EVIDENCE, LONG = 0.35, 14.0, 19
#: Characters of the shortest run that is scored: the pairs of shorter ones can't give the evidence asked for, or only where all of them are rare.
SHORTEST = 8
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
#: Different characters of a span, at least: separator lines have fewer, a random string of 20 digits has fewer once in 500,000.
DISTINCT = 5


_BLANK = "cast(array() as array<string>)"


def find(text: str, kinds: list[tuple[str, str, Column]]) -> dict[str, Column]:
    """Step 1: for each (name, pattern, may), the leftmost non-overlapping matches, where ``may`` holds; else an empty array."""
    return {f"m_{k}": F.when(may, F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(F.expr(_BLANK)) for k, rx, may in kinds}


def gap_lengths(text: str, kinds: list[tuple[str, str, Column]]) -> dict[str, Column]:
    """Step 2: lengths of the texts before each match; texts without a match aren't split."""
    return {f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.transform(F.split(text, rx, -1), F.length)) for k, rx, _ in kinds}


def block_starts(kinds: list[str]) -> dict[str, Column]:
    """Step 3: where every _BLOCK-th match begins, so that very many matches cost no square of their number."""
    total = "aggregate(sequence(int(b) * {n} + 1, least(int(b) * {n} + {n}, size(m_{k}))), 0, (x, j) -> x + get(g_{k}, j - 1) + length(get(m_{k}, j - 1)))"
    blocks = "if(size(m_{k}) > 0, aggregate(sequence(0, (size(m_{k}) - 1) div {n}), array(0), (acc, b) -> array_append(acc, element_at(acc, -1) + " + total + ")), null)"
    return {f"b_{k}": F.expr(blocks.format(k=k, n=_BLOCK)) for k in kinds}


def placed(kinds: list[str], only: dict[str, str]) -> dict[str, Column]:
    """Step 4: structs start, end, kind, s of the matches, for kinds in ``only`` of those for whose string m the condition holds."""
    start = "get(b_{k}, int(i div {n})) + get(g_{k}, i) + if(i % {n} = 0, 0, aggregate(sequence(int(i div {n}) * {n}, i - 1), 0, (x, j) -> x + get(g_{k}, j) + length(get(m_{k}, j))))"
    each = "named_struct('start', " + start + ", 'end', " + start + " + length(m), 'kind', '{k}', 's', m)"
    some = lambda k: f"filter(transform(m_{k}, (m, i) -> if({only[k]}, {each}, null)), y -> y is not null)" if k in only else f"transform(m_{k}, (m, i) -> {each})"
    return {f"p_{k}": F.expr(some(k).replace("{k}", k).replace("{n}", str(_BLOCK))) for k in kinds}


def let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def valued(s: str, ratio: str, body: str) -> str:
    """SQL: ``body`` with v for what each character pair of string ``s`` is worth."""
    values = f"transform(sequence(0, size(i) - 2), j -> get({ratio}, get(i, j) * {_CODES} + get(i, j + 1)))"
    return let(f"transform(split({s}, ''), c -> ascii(c))", "i", let(values, "v", body))


def hope(evidence: float) -> str:
    """SQL: whether any segment of pairs worth ``v`` can have enough evidence: no sum is over that of all pairs that favour randomness, nor is more asked of any part than of the whole."""
    return f"aggregate(v, 0D, (a, y) -> a + greatest(y, 0D)) > {evidence!r}D * greatest(0D, 1D - size(v) / {LONG}D)"


def pair_logs(samples: DataFrame) -> tuple[list[float], list[float]]:
    """Log-probabilities of each next character given the one before, row by row of ALPHABET, for label 1 and label 0 of ``samples`` (s, label); those of label 0 hold for names in capitals, too."""
    k = len(ALPHABET)
    s = F.col("s").cast("string")
    pairs = samples.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))).alias("p"))
    a, b = F.instr(F.lit(ALPHABET), F.substring("p", 1, 1)), F.instr(F.lit(ALPHABET), F.substring("p", 2, 1))
    counts = pairs.where("length(p) = 2").select("label", a.alias("a"), b.alias("b")).where("a > 0 and b > 0").groupBy("label", "a", "b").count()
    out = []
    rows = counts.collect()  # at most 2 * len(ALPHABET) ** 2
    for label in (1, 0):
        n = {(r["a"] - 1, r["b"] - 1): r["count"] for r in rows if r["label"] == label}
        if label == 0:  # ordinary names are written in capitals now and then, too
            capital = lambda i: ALPHABET.index(ALPHABET[i].upper())
            for (i, j), c in list(n.items()):
                at = capital(i), capital(j)
                if at != (i, j) and not (ALPHABET[i].isupper() or ALPHABET[j].isupper()):
                    n[at] = n.get(at, 0) + CAPITALS * c
        totals = [sum(n.get((i, j), 0) for j in range(k)) for i in range(k)]
        into = [sum(n.get((i, j), 0) for i in range(k)) + 1 for j in range(k)]
        share = [x / sum(into) for x in into]
        out.append([log((n.get((i, j), 0) + k * share[j]) / (totals[i] + k)) for i in range(k) for j in range(k)])
    return out[0], out[1]


def default_samples(spark: SparkSession, words: DataFrame, n: int = 4000) -> DataFrame:
    """Labelled samples: random strings (digests in several alphabets) as 1; words of ``words`` (text), alone and joined as identifiers with numbers, as 0."""
    seed = F.sha2(F.concat(F.lit("sample-"), F.col("id")), 512)
    raw = F.unhex(seed)
    random = spark.range(n).select(F.explode(F.array(F.replace(F.base64(raw), F.lit("\r\n"), F.lit("")), F.upper(F.substring(seed, 1, 40)), F.substring(seed, 41, 64), F.replace(F.base64(F.unhex(F.substring(seed, 1, 60))), F.lit("\r\n"), F.lit("")))).alias("s"), F.lit(1).alias("label"))
    w = words.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("s")).groupBy("s").count().orderBy(F.desc("count"), "s").limit(n).select("s")
    number = F.pmod(F.xxhash64("s"), F.lit(1000)).cast("string")
    cap = F.initcap("s")
    plain = w.select(F.explode(F.array(F.col("s"), F.concat("s", F.lit("_"), F.lower("s"), F.lit("_"), number), F.concat(F.lower("s"), cap, number), F.concat(F.lower("s"), F.lit("-"), F.lower("s"), F.lit("/"), cap, F.lit("="), number))).alias("s"), F.lit(0).alias("label"))
    return random.unionByName(plain)


def pieces(found: str, base: str) -> Column:
    """What is left of the runs outside the base spans, where it is long enough."""
    hit = f"filter({base}, y -> y.start < x.end and x.start < y.end)"
    begins = f"array_distinct(concat(array(x.start), {hit}.end))"
    end = f"array_min(concat(array(x.end), filter({hit}.start, e -> e >= b)))"
    left = f"filter(transform({begins}, b -> struct(b as start, {end} as end)), z -> z.end - z.start >= {SHORTEST} and not exists({base}, y -> y.start <= z.start and z.start < y.end))"
    cut = f"transform({left}, z -> struct(z.start as start, z.end as end, substring(x.s, z.start - x.start + 1, z.end - z.start) as s))"
    whole = "array(struct(x.start as start, x.end as end, x.s as s))"
    return F.expr(f"flatten(transform({found}, x -> if(exists({base}, y -> y.start < x.end and x.start < y.end), {cut}, {whole})))")


def segments(v: str, evidence: float) -> str:
    """SQL: the segments of the pairs' values ``v`` as structs b, e (first and last pair), apart and in order.

    A sum over n pairs must be over ``evidence``, less a share n / LONG of it, so over
    0 from LONG pairs on. State: s, the sum since b, where the sum was least; h, its
    peak so far, once it is enough (then the segment is open), at e; n, the best sum
    of pairs behind the peak, since c. A segment ends at its peak when the sum has
    fallen by ``evidence`` below it, or when the pairs behind it are enough themselves.
    """
    need = lambda begin: f"{evidence!r}D * greatest(0D, 1D - (j - {begin} + 1) / {LONG}D)"
    start = "named_struct('s', double(0), 'b', 0, 'h', double(-1), 'e', -1, 'n', double(0), 'c', 0, 'out', cast(array() as array<struct<b: int, e: int>>))"
    # First what depends on the state alone, as a struct x, then the new state.
    step = f"named_struct('s', a.s + get({v}, j), 'n', greatest(double(0), a.n + get({v}, j)), 'c', if(a.n + get({v}, j) <= 0, j + 1, a.c))"
    closed = "array_append(a.out, named_struct('b', a.b, 'e', a.e))"
    state = lambda s, b, h, e, n, c, out: f"named_struct('s', {s}, 'b', {b}, 'h', {h}, 'e', {e}, 'n', {n}, 'c', {c}, 'out', {out})"
    none = "double(-1)"
    higher = state("x.s", "a.b", "x.s", "j", "double(0)", "j + 1", "a.out")
    again = state("x.n", "x.c", f"if(x.n > {need('x.c')}, x.n, {none})", f"if(x.n > {need('x.c')}, j, -1)", "x.n", "x.c", closed)
    same = state("x.s", "a.b", "a.h", "a.e", "x.n", "x.c", "a.out")
    lower = state("double(0)", "j + 1", none, "-1", "double(0)", "j + 1", "a.out")
    while_open = f"if(x.s > a.h, {higher}, if(x.s < a.h - {evidence!r}D or (x.n > 0 and x.n > {need('x.c')}), {again}, {same}))"
    while_shut = f"if(x.s <= 0, {lower}, if(x.s > {need('a.b')}, {higher}, {same}))"
    new = f"get(transform(array({step}), x -> if(a.h > 0, {while_open}, {while_shut})), 0)"
    return f"aggregate(sequence(0, size({v}) - 1), {start}, (a, j) -> {new}, a -> if(a.h > 0, {closed}, a.out))"


def favoured(found: str, ratio: str, evidence: float) -> Column:
    """Spans of the segments that the ratio favours in each of ``found`` (start, s)."""
    # Segments as characters b to e (exclusive), grown to the separators and over short pieces next to them (base64 has separators in it);
    # a "=" before is none of the segment's, padding behind is.
    short = "[A-Za-z0-9]{0,4}+(?![A-Za-z0-9])"
    word = lambda c: f"if({c} rlike '[A-Za-z0-9]', '^[A-Za-z0-9]*+', '^{short}')"
    back = f"length(regexp_extract(reverse(substring(x.s, 1, q.b)), concat({word('substring(x.s, q.b + 1, 1)')}, '(?:[+/_-]{short})*+'), 0))"
    on = f"length(regexp_extract(substring(x.s, q.e + 1), concat({word('substring(x.s, q.e, 1)')}, '(?:[+/_-]{short})*+(?:={{1,2}}$)?'), 0))"
    grown = f"named_struct('b', if(substring(x.s, q.b + 1, 1) = '=', q.b + 1, q.b - {back}), 'e', q.e + {on})"
    cut = f"transform({segments('v', evidence)}, g -> named_struct('b', g.b, 'e', g.e + 2))"
    merged = "aggregate(g, cast(array() as array<struct<b: int, e: int>>), (a, y) -> if(size(a) > 0 and y.b < element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(named_struct('b', element_at(a, -1).b, 'e', greatest(y.e, element_at(a, -1).e)))), array_append(a, y)))"
    spans = f"transform({merged}, y -> named_struct('start', x.start + y.b, 'end', x.start + y.e, 'kind', 'markov', 's', substring(x.s, y.b + 1, y.e - y.b)))"
    spans = f"filter({spans}, y -> y.end - y.start >= {SHORTEST} and size(array_distinct(split(y.s, ''))) >= {DISTINCT})"
    none = "cast(array() as array<struct<start: int, end: int, kind: string, s: string>>)"
    grown_all = let(f"transform({cut}, q -> {grown})", "g", spans)
    whole = valued("x.s", ratio, f"if({hope(evidence)}, {grown_all}, {none})")
    return F.expr(f"flatten(transform({found}, x -> {whole}))")


def scan_secrets(docs: DataFrame, samples: DataFrame, margin: float = MARGIN, evidence: float = EVIDENCE) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind, s, in order) for every row of ``docs``. A segment's log-likelihood ratio, less ``margin`` for each character pair, must be over what is left of ``evidence`` at its length: short ones need a higher ratio for each pair."""
    one, zero = pair_logs(samples)
    # What each pair of character codes is worth; pairs outside the alphabet don't occur in runs.
    worth, k = [0.0] * _CODES**2, len(ALPHABET)
    for i, a in enumerate(ALPHABET):
        for j, b in enumerate(ALPHABET):
            worth[ord(a) * _CODES + ord(b)] = one[i * k + j] - zero[i * k + j] - margin
    ratio = F.split(F.lit(" ".join(map(repr, worth))), " ").cast("array<double>")  # folded to one literal when the query is planned
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("t"))
    low = F.lower("t")
    keyword = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in ("password", "passwd", "secret", "token", "apikey", "api_key")))
    t = F.col("t")
    kinds = [("assign", ASSIGN, keyword), ("access", ACCESS, F.contains(t, F.lit("AKIA"))), ("hex", HEX, F.lit(True)), ("markov", CANDIDATE, F.lit(True))]
    out = base.withColumns(find("t", kinds)).withColumns(gap_lengths("t", kinds)).drop("t")
    out = out.withColumn("ratio", ratio).withColumns(block_starts(KINDS)).withColumns(placed(KINDS, {"markov": valued("m", "ratio", hope(evidence))}))
    out = out.select("doc_id", "ratio", *(f"p_{k}" for k in KINDS))
    value = lambda x: F.regexp_extract(x["s"], "^" + ASSIGN, 2)
    out = out.withColumn("p_assign", F.filter("p_assign", lambda x: F.length(value(x)) >= 6))
    out = out.withColumn("base", F.concat("p_assign", "p_access", "p_hex"))
    out = out.withColumn("p_markov", pieces("p_markov", "base"))
    out = out.withColumn("p_markov", favoured("p_markov", "ratio", evidence))
    return out.select("doc_id", _sorted(F.col("base")).alias("base"), _sorted(F.concat("base", "p_markov")).alias("spans"))


def _sorted(found: Column) -> Column:
    """By start, then by kind in the order of KINDS."""
    rank = lambda x: F.array_position(F.lit(KINDS), x["kind"])
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s"))))
    return F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s")))


def joined(found: str) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), default_samples(spark, table(spark, sf_dir, "benchmark")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
