"""Secret scans: fixed patterns, and character Markov models for the strings that no pattern names.

The patterns find assignments, access keys and long hexadecimal strings. Two first-order Markov models of characters, one of
random strings and one of ordinary identifiers, score every other token of TOKEN characters or more that mixes letters and
digits; where the log-likelihood ratio is at least RATIO nats, the token is a span of kind random. The models are trained on
labelled samples, a table of strings and whether each is random. The one that is used where none is given is made by rule and
does not look at the corpus: digests in base 64 and in hexadecimal are the random strings, pairs of WORDS in the usual spellings, with and
without numbers, the identifiers. Counts are of character pairs, so a model never has more than ALPHABET squared entries.

Everything runs as DataFrame functions. Positions come from splitting a text by a pattern: the lengths of what stands between
the matches, and of the matches, add up to where each begins. Sums run over stretches of STRETCH matches and then over the
stretches, as a list that grows by one match at a time would be copied each time; masking cuts a text in the same two steps.

Defined results: positions are code points, ends exclusive; null and empty texts have no spans; matches of a kind do not
overlap, those of different kinds may; random tokens are looked for in what the patterns leave; with samples of one label or
none the models know nothing and add nothing; repeated rows give repeated rows; empty tables give empty tables; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.llm import _tables

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 20 or 24 characters is what is left of the runs of one or more after the shorter ones are dropped.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-."
TOKEN = 16
STRETCH = 128
RATIO = 12.0
#: Weight of the lower-order chance, in character pairs.
BACKOFF = 20.0
MASK = "[secret]"
#: Random strings of each kind in the sample that is made by rule.
DIGESTS = 4000
WORDS = (
    "access account action active address admin agent alert allow amount answer archive array author backup balance batch before block body border "
    "bucket buffer build button cache call channel check child class client cluster code collect color column command comment common compute config "
    "connect content context control copy count create current custom daily data date default delete deploy device display document domain download "
    "driver element email enable engine entry error event export factory failed feature field file filter final folder format forward frame function "
    "gateway global group handle hash header height hidden history host image import index info input insert instance internal item join key label "
    "language last layout length level library limit line link list local lock login lookup manager map market master match max member memory menu "
    "merge message method metric min mobile mode model module monitor name native network next node normal note number object offset option order "
    "output owner package page panel parent parse partition path pattern payment pending person phone plugin point policy port position previous price "
    "primary process product profile project property public query queue random range read record region register remote remove report request reset "
    "resource response result return role route rule sample schema score screen search section select sender sequence server service session setting "
    "shared signal simple single size sort source stage start state status step storage store stream string submit summary support system table target "
    "task template temp test text thread time title total trace track transfer trigger type unique update upload user valid value vector version view "
    "visible volume warning weight width window worker write year"
)

_TOKENS = f"[A-Za-z0-9+/=_-]{{{TOKEN},}}"
_CLASS = "A-Za-z0-9+/=_.-"
_NONE = "cast(array() as array<struct<start:int,k:int,end:int,value:string>>)"


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, which an expression that a function names again and again is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _zip(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def _stretches(values: Column) -> Column:
    """A list cut into lists of STRETCH."""
    cuts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRETCH).cast("int")))
    return F.transform(cuts, lambda i: F.slice(values, i * STRETCH + 1, F.lit(STRETCH)))


def _running(values: Column, join, start: int = 0) -> Column:
    """join() of each value of a list of whole numbers with all before it; joined in any grouping, the result has to be the same."""

    def along(part: Column) -> Column:
        first = F.struct(F.lit(start).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda state, x: F.struct(join(state["at"], x).alias("at"), F.concat(state["out"], F.array(join(state["at"], x))).alias("out"))
        return F.aggregate(part, first, step, lambda state: state["out"])

    def over(parts: Column) -> Column:
        inner = F.transform(parts, along)
        return _let(inner, lambda sums: outer(sums))

    def outer(sums: Column) -> Column:
        ends = along(F.transform(sums, lambda x: F.element_at(x, -1)))
        before = F.concat(F.array(F.lit(start)), ends)
        return F.flatten(F.transform(_zip(sums, F.slice(before, 1, F.size(sums))), lambda x: F.transform(x["a"], lambda v: join(x["b"], v))))

    return F.coalesce(_let(values, lambda v: _let(_stretches(v), over)), F.expr("cast(array() as array<int>)"))


def _found(pattern: str, group: int, kind: int, maybe: Column, text: str = "text") -> Column:
    """Spans of a pattern's matches in a column, with a group of each; maybe: a cheap test that all texts with matches pass."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.struct(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def spans(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["gap"], 1, F.size(x["whole"])), x["whole"], lambda gap, w: gap + F.length(w))
        return _let(_running(sizes, lambda a, b: a + b), lambda ends: F.transform(_zip(_zip(ends, x["whole"]), x["value"]), one))

    def one(x: Column) -> Column:
        return F.struct((x["a"]["a"] - F.length(x["a"]["b"])).alias("start"), F.lit(kind).alias("k"), x["a"]["a"].alias("end"), x["b"].alias("value"))

    return F.when(maybe & F.col(text).rlike(pattern), _let(parts, spans)).otherwise(F.expr(_NONE))


def patterned(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, columns keep, spans of the fixed patterns by start and kind."""
    sign = F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    kinds = texts.select(
        "doc_id",
        "text",
        *keep,
        F.filter(_found(ASSIGN, 1, 0, sign), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        _found(ACCESS, 0, 1, F.contains("text", F.lit("AKIA"))).alias("access"),
        _found(HEX, 0, 2, F.lit(True)).alias("hex"),
    )
    return kinds.select("doc_id", "text", *keep, F.array_sort(F.concat("assign", "access", "hex")).alias("spans"))


def _pairs(values: DataFrame) -> DataFrame:
    """pair, random, n: counts of pairs of neighbouring characters in column value, by label."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2))))
    return values.where("length(value) > 1 and random in (0, 1)").select(pair.alias("pair"), "random").groupBy("pair", "random").agg(F.count("*").alias("n"))


def samples(spark: SparkSession) -> DataFrame:
    """value, random: labelled strings made by rule; see the module's text."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    secrets = spark.range(DIGESTS).select(F.explode(F.array(plain, F.translate(plain, "+/", "-_"), F.substring(digest, 1, 40))).alias("value"), F.lit(1).alias("random"))
    words = F.split(F.lit(WORDS), " ")
    pairs = spark.range(1).select(F.explode(words).alias("a")).select("a", F.explode(words).alias("b"), (F.pmod(F.xxhash64("a"), F.lit(100))).cast("string").alias("n"))
    spelt = F.array(
        F.concat_ws("_", "a", "b"), F.concat_ws("_", F.upper("a"), F.upper("b")), F.concat("a", F.initcap("b")), F.concat(F.initcap("a"), F.initcap("b")), F.concat("a", "b"),
        F.concat_ws("-", "a", "b", "n"), F.concat_ws("_", "a", "b", "n"), F.concat("a", F.initcap("b"), "n"), F.concat_ws(".", "a", "b"), F.concat_ws("/", "a", "b"), F.concat_ws("_v", "a", "n"),
    )
    return secrets.unionByName(pairs.select(F.explode(spelt).alias("value"), F.lit(0).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of a character after another, random against identifier, by place in ALPHABET squared; labelled:
    value, random (1 or 0), rows with a null are left out."""
    counts = _pairs(labelled)
    size, place = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    tables = [[0.0] * size**2 for _ in range(2)]
    for r in counts.where(F.col("pair").rlike(f"^[{_CLASS}]{{2}}$")).collect():  # twice ALPHABET squared rows at most
        if len(r.pair) == 2 and r.pair[0] in place and r.pair[1] in place:
            tables[r.random][place[r.pair[0]] * size + place[r.pair[1]]] += r.n
    if not all(map(sum, tables)):
        return [0.0] * size**2
    logs = []
    for table in tables:
        # A pair's chance falls back on that of its second character alone, which falls back on an even one.
        alone = [(sum(table[j::size]) + 0.5) / (sum(table) + 0.5 * size) for j in range(size)]
        after = [sum(table[i * size : (i + 1) * size]) for i in range(size)]
        logs.append([math.log((n + BACKOFF * alone[i % size]) / (after[i // size] + BACKOFF)) for i, n in enumerate(table)])
    return [a - b for a, b in zip(logs[1], logs[0])]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of ALPHABET characters."""
    table = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in model) + "', ',') as array<double>)")
    steps = F.sequence(F.lit(1), F.length(value) - 1)
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1
    return F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.get(table, at(i) * len(ALPHABET) + at(i + 1)))


def scan(docs: DataFrame, model: list[float], *, least: float = RATIO, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, columns keep, base (spans of the patterns), spans (these and the random tokens), each by start and kind."""
    found = patterned(docs, keep).withColumnRenamed("spans", "base")
    left = found.withColumn("left", masked("text", "base", None))
    tokens = F.filter(_found(_TOKENS, 0, 3, F.lit(True), "left"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    found = left.withColumn("tokens", tokens).drop("left")
    random = F.filter("tokens", lambda s: ratio(s["value"], model) >= least)
    return found.withColumn("spans", F.when(F.size("tokens") > 0, F.array_sort(F.concat("base", random))).otherwise(F.col("base"))).drop("tokens")


def listed(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: str, mask: str | None = MASK) -> Column:
    """The text with each span, or run of overlapping spans, replaced; without a mask by as many spaces."""
    whole = F.col(text)

    def pieces(part: Column) -> Column:
        first, last = F.element_at(part, 1), F.element_at(part, -1)
        own = F.substring(whole, first["low"] + 1, last["end"] - first["low"])
        cut = lambda t, x: F.concat(F.substring(t["own"], x["low"] - t["at"] + 1, x["start"] - x["low"]), F.lit(mask) if mask is not None else F.repeat(F.lit(" "), x["end"] - x["start"]))
        return _let(F.struct(own.alias("own"), first["low"].alias("at"), part.alias("part")), lambda t: F.array_join(F.transform(t["part"], lambda x: cut(t, x)), ""))

    def runs(reach: Column) -> Column:
        """Runs of overlapping spans: low, where the run before ends, start and end."""
        before = F.slice(F.concat(F.array(F.lit(0)), reach), 1, F.size(reach))
        new = F.filter(_zip(F.col(spans), before), lambda x: x["a"]["start"] >= x["b"])
        return _let(new, lambda new: F.when(F.size(new) > 0, ends(new, reach)))

    def ends(new: Column, reach: Column) -> Column:
        after = F.concat(F.transform(F.slice(new, 2, F.size(new)), lambda x: x["b"]), F.array(F.element_at(reach, -1)))
        return F.transform(_zip(new, after), lambda x: F.struct(x["a"]["b"].alias("low"), x["a"]["a"]["start"].alias("start"), x["b"].alias("end")))

    def text_of(found: Column) -> Column:
        return F.concat(F.array_join(F.transform(_stretches(found), pieces), ""), F.substring(whole, F.element_at(found, -1)["end"] + 1, F.length(whole)))

    reach = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, _let(_let(reach, runs), text_of)).otherwise(whole)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _tables.read(spark, sf_dir, "documents", "doc_id", "text")
    return summary(scan(docs, train(samples(spark))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_secret_scan": op10_secret_scan}
