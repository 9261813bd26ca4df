"""URL filter: rules first, then a character language-model ratio.

Rules name a host (with all its subdomains) and a path prefix; the longest
rule that fits decides.  URLs decided by rules train two variable-order Markov
models over characters, one of accepted and one of rejected URLs, smoothed by
Witten-Bell interpolation from the longest context down to a uniform base.  A
URL without a rule goes by the difference of its log-likelihoods per
character, against a threshold calibrated where the error rates of the two
training classes meet; for that, each training URL is rated by a model of the
other half of them.

Everything is DataFrame functions: character sequences are exploded, counted
by map-side combining aggregates, and probabilities are built one order on
the other, once per distinct sequence.

Defined cases: a null URL has an empty host and path, no rule, and is judged as
the empty string; equal URLs count as often as they stand; without URLs of
both classes everything undecided is allowed; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, spread_join

#: (verdict, host, path) of the contract's rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Characters of the longest sequence: a context and the character after it.
ORDER = 5
#: The base below order 1: one of so many characters, each as likely.
ALPHABET = 256
START, END = "\u0002", "\u0003"


def parts(url: str = "url") -> dict[str, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return {"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path}


def decide(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled``, the text and verdict of the longest rule that fits, to (host, path)."""
    rule = said = F.lit(None).cast("string")
    # Shortest first, so the longest is tested last and stands outermost.
    for verdict, host, path in sorted(rules, key=lambda x: (len(x[1] + x[2]), x[1] + x[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, said = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return pages.withColumns({"rule": rule, "ruled": said})


def sequences(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(row, ruled, fold, g): every character of a URL, and its end, with the ``order`` - 1 characters before it."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("url"), F.lit(END))
    starts = F.sequence(F.lit(1), F.length("url") + 1)
    return rows.select("row", "ruled", "fold", F.explode(F.transform(starts, lambda i: F.substring(padded, i, F.lit(order)))).alias("g"))


#: Counts of a sequence by class (a: accepted, b: rejected) and fold; models from all of them, and from either fold.
COUNTS = ("a0", "a1", "b0", "b1")
MODELS = {"ratio": (("a0", "a1"), ("b0", "b1")), "by0": (("a0",), ("b0",)), "by1": (("a1",), ("b1",))}


def log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, ratio, by0, by1): log of the accepted over the rejected model's probability, for each distinct sequence and model.

    ``grams`` holds (g, a0, a1, b0, b1): a sequence and how often it stands in training URLs.
    """
    sides = {f"{name}_{x}": sum(map(F.col, counts[1:]), F.col(counts[0])) for name, pair in MODELS.items() for x, counts in zip("ab", pair, strict=True)}
    below = None
    for k in range(1, order + 1):
        tail = F.substring("g", order - k + 1, k)
        level = grams.groupBy(tail.alias("s")).agg(*(F.sum(c).alias(n) for n, c in sides.items()))
        level = level.withColumn("context", F.substring("s", 1, k - 1))
        seen = level.groupBy("context").agg(*(f(x).alias(x + n) for x in sides for n, f in (("_all", F.sum), ("_kinds", lambda c: F.count_if(F.col(c) > 0)))))
        level = level.join(seen, "context")
        if below is None:
            level = level.withColumns({"p_" + x: F.lit(1.0 / ALPHABET) for x in sides})
        else:
            level = level.withColumn("t", F.substring("s", 2, k - 1)).join(below.withColumnRenamed("s", "t"), "t")
        # A context never seen leaves the shorter context's probability as it is.
        mixed = {"p_" + x: F.when(F.col(x + "_all") > 0, (F.col(x) + F.col(x + "_kinds") * F.col("p_" + x)) / (F.col(x + "_all") + F.col(x + "_kinds"))).otherwise(F.col("p_" + x)) for x in sides}
        below = level.select("s", *(c.alias(n) for n, c in mixed.items()))
    return below.select(F.col("s").alias("g"), *((F.log(f"p_{n}_a") - F.log(f"p_{n}_b")).alias(n) for n in MODELS))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """(page_id, url, host, path, rule, ruled, ratio, threshold, verdict) of each row of ``pages`` (page_id, url)."""
    named = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    folded = decide(named.withColumns(parts()), rules).withColumn("fold", F.instr(F.lit("13579bdf"), F.substring(F.md5("url"), 1, 1)).cast("boolean").cast("int"))
    rows = durable(folded, "urls")
    places = sequences(rows, order)
    # Counted before anything is joined: a sequence that stands in every URL is one row from each task.
    counted = (F.count_if((F.col("ruled") == ("allow" if c[0] == "a" else "block")) & (F.col("fold") == int(c[1]))).alias(c) for c in COUNTS)
    grams = durable(places.groupBy("g").agg(*counted, F.count("*").alias("n")), "sequences")
    ratios = durable(log_ratios(grams, order).join(grams.select("g", "n"), "g"), "ratios")
    # Beyond the bound, a sequence that opens nearly all URLs is dealt over several tasks.
    met = places.select("row", "g").join(F.broadcast(ratios), "g") if ratios.count() <= BROADCAST_ROWS else spread_join(places.select("row", "g"), ratios, ["g"], "n", "row")
    scored = met.groupBy("row").agg(*(F.avg(n).alias(n) for n in MODELS))
    rated = durable(rows.join(scored, "row"), "rated")
    # A training URL is rated, for the threshold, by the model of the other fold.
    apart = F.when(F.col("fold") == 0, F.col("by1")).otherwise(F.col("by0"))
    sides = [F.struct(F.avg(x).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("sd")).alias(n) for n, x in (("a", F.when(F.col("ruled") == "allow", apart)), ("b", F.when(F.col("ruled") == "block", apart)))]
    spread = F.col("a.sd") + F.col("b.sd")
    meeting = F.when(spread > 0, (F.col("a.mean") * F.col("b.sd") + F.col("b.mean") * F.col("a.sd")) / spread).otherwise((F.col("a.mean") + F.col("b.mean")) / 2)
    threshold = rated.agg(*sides).select(meeting.alias("threshold"))
    by_ratio = F.when(F.col("ratio") < F.col("threshold"), F.lit("block")).otherwise(F.lit("allow"))
    return rated.join(F.broadcast(threshold)).withColumn("verdict", F.coalesce("ruled", by_ratio))


def sql(rules=RULES, order: int = ORDER, alphabet: int = ALPHABET) -> str:
    """The same judgement as one SQL statement over ``pages``."""
    fits = lambda host, path: f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}'))"
    longest = sorted(rules, key=lambda x: (-len(x[1] + x[2]), x[1] + x[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(v, h, p)}'" for v, h, p in longest) + " END"
    sides = {f"{name}_{x}": " + ".join(counts) for name, pair in MODELS.items() for x, counts in zip("ab", pair, strict=True)}
    steps = [f"p0 AS (SELECT '' AS s, {', '.join(f'{1.0 / alphabet}::DOUBLE AS p_{x}' for x in sides)})"]
    for k in range(1, order + 1):
        mixed = ", ".join(f"CASE WHEN {x}_all > 0 THEN ({x} + {x}_kinds * p_{x}) / ({x}_all + {x}_kinds) ELSE p_{x} END AS p_{x}" for x in sides)
        steps += [
            f"l{k} AS (SELECT substr(g, {order - k + 1}, {k}) AS s, {', '.join(f'sum({c}) AS {x}' for x, c in sides.items())} FROM grams GROUP BY 1)",
            f"c{k} AS (SELECT substr(s, 1, {k - 1}) AS context, {', '.join(f'sum({x}) AS {x}_all, count(*) FILTER ({x} > 0) AS {x}_kinds' for x in sides)} FROM l{k} GROUP BY 1)",
            f"p{k} AS (SELECT l{k}.s, {mixed} FROM l{k} JOIN c{k} ON substr(l{k}.s, 1, {k - 1}) = context JOIN p{k - 1} ON " + ("TRUE" if k == 1 else f"substr(l{k}.s, 2, {k - 1}) = p{k - 1}.s") + ")",
        ]
    counted = ", ".join(f"count(*) FILTER (ruled = '{'allow' if c[0] == 'a' else 'block'}' AND fold = {c[1]}) AS {c}" for c in COUNTS)
    ratios = ", ".join(f"avg(ln(p_{n}_a) - ln(p_{n}_b)) AS {n}" for n in MODELS)
    apart = "CASE WHEN fold = 0 THEN by1 ELSE by0 END"
    rated = ", ".join(f"{f}({apart}) FILTER (ruled = '{v}') AS {n}{x}" for x, v in (("a", "allow"), ("b", "block")) for f, n in (("avg", "m"), ("stddev_pop", "d")))
    return f"""WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
  v AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
  w AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    CASE WHEN instr('13579bdf', substr(md5(url), 1, 1)) > 0 THEN 1 ELSE 0 END AS fold FROM v),
  ruled AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM w),
  places AS (SELECT r, ruled, fold, substr(repeat(chr(2), {order - 1}) || url || chr(3), i, {order}) AS g FROM (SELECT *, unnest(range(1, length(url) + 2)) AS i FROM ruled)),
  grams AS (SELECT g, {counted} FROM places GROUP BY 1), {", ".join(steps)},
  scored AS (SELECT r, {ratios} FROM places JOIN p{order} ON g = s GROUP BY 1), rated AS (SELECT * FROM ruled JOIN scored USING (r)), sides AS (SELECT {rated} FROM rated),
  cut AS (SELECT CASE WHEN da + db > 0 THEN (ma * db + mb * da) / (da + db) ELSE (ma + mb) / 2 END AS threshold FROM sides)
  SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN ratio < threshold THEN 'block' ELSE 'allow' END) AS verdict FROM rated, cut"""
