"""Sentences and words of a corpus without a trained model: what ends a sentence is learned from the corpus itself.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006): a word that nearly always has a period
is an abbreviation, a word that often follows a sure end starts sentences, a number or initial and the word after it may
belong together. All three are likelihood ratios of counts, and all counts come from one pass over the corpus that keeps a
row for each kind of pair of neighbours; whether a period ends a sentence depends on nothing but its pair, so it is decided
once for each kind of pair, and a text only has to look up the few pairs that hold it together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from claimworks.operators.lineage import written

#: What tokens are: runs of anything but these.
TOKEN = r"[^\x09-\x0D\x20]+"
#: Set aside at both ends of a token.
WRAPS = "\"'`()[]{}<>«»„“”‘’‚‹›¿¡*"
NUMBER = r"^[-+]?[0-9][0-9.,:/-]*$"
#: Least scores of abbreviations, sentence starters, collocations: fixed values of the paper.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88


#: Bytes that separate tokens (just those of bytes.split()) and those that let a token be the last of a sentence, at a glance, as … does.
_BLANK, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]], _MARK[list(b".!?")] = True, True


def _bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens begin, where they end, and the bytes."""
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
    return edges[::2], edges[1::2], data


def _after_marks(text: bytes) -> tuple[list[int], list[str], list[str]]:
    """pos, p, c: the places (from 0) and cores of the tokens after one that has a mark, and that one's core."""
    starts, ends, data = _bounds(text)
    at = np.flatnonzero(_MARK[data])
    if b"\xe2\x80\xa6" in text:
        at = np.union1d(at, np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] == 0xA6)))
    owner = np.unique(np.searchsorted(starts, at, "right") - 1)
    owner = owner[owner < len(starts) - 1]
    cores = lambda k: [text[a:z].decode().strip(WRAPS) for a, z in zip(starts[k].tolist(), ends[k].tolist())]
    return (owner + 1).tolist(), cores(owner), cores(owner + 1)


def _met(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """p, c, k: how often each core comes first (p is null), after one with a mark (p), or after another ("-")."""
    after, alone = Counter(), Counter()

    def out() -> pa.RecordBatch:
        alone.pop(None, None)
        p, c = [x for x, _ in after] + ["-"] * len(alone), [x for _, x in after] + [t.decode().strip(WRAPS) for t in alone]
        made = pa.record_batch([pa.array(p, pa.string()), pa.array(c, pa.string()), pa.array([*after.values(), *alone.values()], pa.int64())], names=["p", "c", "k"])
        after.clear()
        alone.clear()
        return made

    for b in batches:
        for x in b.column(0):
            text = x.as_py()
            toks = text.split()
            if toks:
                places, p, c = _after_marks(text)
                after.update(zip(p, c))
                after[None, toks[0].decode().strip(WRAPS)] += 1
                for i in (0, *places):
                    toks[i] = None
                alone.update(toks)
            if len(after) + len(alone) > most:
                yield out()
    yield out()


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 0), p, c: the cores of tokens after one that has a mark, and of that one; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, columns = [], ([], [], [])
            for i, x in enumerate(b.column(1)):
                found = _after_marks(x.as_py())
                rows += [i] * len(found[0])
                for all_, new in zip(columns, found):
                    all_ += new
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns, (pa.int32(), pa.string(), pa.string()))], names=["k", "pos", "p", "c"])

    listed = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    schema = StructType([StructField("k", docs.schema[key].dataType), StructField("pos", IntegerType()), StructField("p", StringType()), StructField("c", StringType())])
    return listed.mapInArrow(run, schema).withColumnRenamed("k", key)


def _type(core: Column) -> Column:
    """A token without periods at its end, in lower case; all numbers are one type."""
    bare = F.rtrim(core, F.lit("."))
    return F.when(bare.rlike(NUMBER), "#").otherwise(F.lower(bare))


def _end(core: Column) -> Column:
    """How a token ends: m(ark), e(llipsis), n(umber), i(nitial), p(eriod), or not at all; s where there is none before."""
    ends = core.endswith(".")
    return (
        F.when(core.isNull(), "s").when(core.endswith("!") | core.endswith("?"), "m").when(core.endswith("..") | core.endswith("…"), "e")
        .when(ends & core.rlike(r"^[-+]?[0-9][0-9.,:/-]*$"), "n").when(ends & core.rlike(r"^\p{L}\.$"), "i").when(ends, "p").otherwise("")
    )


def neighbours(cores: DataFrame) -> DataFrame:
    """Tokens and those before them, without what is set aside at their ends (c, p), with end and before (how p ends, and its type if with a period), typ, case, period."""
    # One step after the other: each is read several times by the next and is to be worked out once.
    cores = cores.withColumns({"end": _end(F.col("p")), "typ": _type(F.col("c")), "first": F.substring("c", 1, 1), "period": _end(F.col("c")).isin("n", "i", "p")})
    before = F.when(F.col("end").isin("e", "n", "i", "p"), _type(F.col("p"))).otherwise("")
    case = F.when(F.col("first").rlike(r"^\p{Lu}"), "u").when(F.col("first").rlike(r"^\p{Ll}"), "l").otherwise("o")
    return cores.withColumns({"before": before, "case": case}).drop("p", "c", "first")


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """end, before, typ, case, period, n: kinds of neighbours and how often they are met. The one pass over the corpus."""
    # Equal pairs are counted as they are written first, so that what they are is worked out once for each; a token without a mark is as good as any.
    listed = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("t"))
    pairs = listed.mapInArrow(_met, "p string, c string, k long").groupBy("p", "c").agg(F.sum("k").alias("k"))
    return written(neighbours(pairs).groupBy("end", "before", "typ", "case", "period").agg(F.sum("k").alias("n")))


def _single(df: DataFrame) -> DataFrame:
    """A table of one row for a join with all rows of another."""
    return F.broadcast(df.withColumn("_k", F.lit(1)))


def _with(df: DataFrame, one: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(1)).join(_single(one), "_k").drop("_k")


def _log(p: Column) -> Column:
    return F.log(F.greatest(F.lit(1e-12), p))


def lexicon(pairs: DataFrame) -> DataFrame:
    """typ, n, n_period, score, abbreviation of every type.

    The score compares a chance of 0.99 for a period with the corpus's own, for short words with inner periods and against
    each time the word lacks one.
    """
    types = pairs.groupBy("typ").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("period"), F.col("n"))), F.lit(0)).alias("n_period"))
    all_ = pairs.agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("period"), F.col("n"))), F.lit(0)).alias("periods"))
    c, n, p = F.col("n_period"), F.col("n"), F.col("periods") / F.col("tokens")
    ratio = -2 * (c * _log(p) + (n - c) * _log(1 - p) - c * F.log(F.lit(0.99)) - (n - c) * F.log(F.lit(0.01)))
    inner = F.length(F.regexp_replace("typ", r"[^.]", ""))
    letters = F.length("typ") - inner
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), (c - n).cast("double"))
    candidate = (c > 0) & F.col("typ").rlike(r"\p{L}")
    scored = _with(types, all_).withColumn("score", F.when(candidate, score))
    return scored.select("typ", "n", "n_period", "score", F.coalesce(F.col("score") >= ABBREVIATION, F.lit(False)).alias("abbreviation"))


def likelihood(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's ratio for two events that are met a and b times, ab of them together, among n."""
    part = lambda k, m, p: k * _log(p) + (m - k) * _log(1 - p)
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(0.0)
    return -2 * (part(ab, a, p) + part(b - ab, n - a, p) - part(ab, a, p1) - part(b - ab, n - a, p2))


def spelling(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """typ, met (how often), starts, likelihood, starter, and whether the type is met in upper or lower case at (beg), within (mid) sentences, anywhere."""
    abbreviations = words.where("abbreviation").select(F.col("typ").alias("before"), F.lit(True).alias("short"))
    placed = pairs.join(abbreviations, "before", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    sure = (F.col("end") == "m") | (F.col("end") == "p") & ~F.col("short")
    placed = placed.withColumns({"sure": sure, "place": F.when(sure | (F.col("end") == "s"), "beg").when(F.col("end") == "", "mid").otherwise("unk")})
    has = lambda case, *places: F.bool_or((F.col("case") == case) & F.col("place").isin(*places))
    starts = F.coalesce(F.sum(F.when(F.col("sure") & F.col("typ").rlike(r"^\p{L}+$"), F.col("n"))), F.lit(0))
    by_type = placed.groupBy("typ").agg(starts.alias("starts"), has("u", "mid").alias("upper_mid"), has("u", "beg", "mid", "unk").alias("upper"), has("l", "beg").alias("lower_beg"), has("l", "beg", "mid", "unk").alias("lower"))
    breaks = placed.agg(F.coalesce(F.sum(F.when(F.col("sure"), F.col("n"))), F.lit(0)).alias("breaks"), F.sum("n").alias("tokens"))
    joined = _with(by_type.join(words.select("typ", F.col("n").alias("met")), "typ"), breaks)
    value = F.when(F.col("starts") > 0, likelihood(F.col("breaks"), F.col("met"), F.col("starts"), F.col("tokens")))
    often = F.col("tokens") * F.col("starts") > F.col("met") * F.col("breaks")
    return joined.withColumn("likelihood", value).withColumn("starter", F.coalesce((F.col("likelihood") >= STARTER) & often, F.lit(False))).drop("breaks", "tokens")


def holding(pairs: DataFrame, words: DataFrame, spelled: DataFrame) -> DataFrame:
    """end, before, typ, case: the kinds of neighbours between which a period ends no sentence."""
    kinds = pairs.where(F.col("end").isin("e", "n", "i", "p")).groupBy("end", "before", "typ", "case").agg(F.sum("n").alias("n"))
    # After a word that is no abbreviation a period always ends a sentence: most kinds are settled by that.
    short = words.where("abbreviation").select(F.col("typ").alias("before"), F.lit(True).alias("short"))
    kinds = kinds.join(short, "before", "left").withColumn("short", F.coalesce("short", F.lit(False)) & F.col("end").isin("i", "p"))
    kinds = written(kinds.where((F.col("end") != "p") | F.col("short")))
    known = kinds.join(words.select(F.col("typ").alias("before"), F.col("n").alias("met_before")), "before").join(spelled, "typ")
    bound = known.where(F.col("end").isin("i", "n") | F.col("short")).groupBy("before", "typ").agg(F.sum("n").alias("together"), F.first("met_before").alias("met_before"), F.first("met").alias("met"), F.first("starter").alias("starter"))
    bound = _with(bound, words.agg(F.sum("n").alias("tokens")))
    tied = (likelihood(F.col("met_before"), F.col("met"), F.col("together"), F.col("tokens")) >= COLLOCATION) & (F.col("tokens") * F.col("together") > F.col("met_before") * F.col("met"))
    known = known.join(bound.where(tied & ~F.col("starter")).select("before", "typ", F.lit(True).alias("tied")), ["before", "typ"], "left")
    case = F.col("case")
    begins = (case == "u") & F.col("lower") & ~F.col("upper_mid")
    runs_on = F.col("typ").rlike(r"^[;:,.!?]*$") | (case == "l") & (F.col("upper") | ~F.col("lower_beg"))
    brief = (F.col("short") | (F.col("end") == "e")) & (F.col("end") != "i")
    holds = (
        F.when(F.col("tied"), True).when(brief, ~(~runs_on & begins | (case == "u") & F.col("starter")))
        .when(F.col("end").isin("i", "n"), F.col("short") | runs_on | ~begins & (F.col("end") == "i") & (case == "u") & ~F.col("lower")).otherwise(False)
    )
    return known.where(holds).select("end", "before", "typ", "case")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", *, counts: bool = False) -> DataFrame:
    """The documents with sentences: each text's in order, without white space around them; null and empty texts have none.

    key tells documents apart. Texts that share one are cut where either is. With counts also n_words: each sentence's words.
    """
    pairs = counted(docs, key, text)
    words = written(lexicon(pairs))
    held = written(holding(pairs, words, written(spelling(pairs, words))))
    ends = neighbours(marked(docs, key, text)).where(F.col("end").isin("m", "e", "n", "i", "p"))
    cuts = ends.join(held, ["end", "before", "typ", "case"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_list("pos")).alias("_cuts"))
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [_sliced((x.as_py() or "").encode(), c.as_py() or []) for x, c in zip(b.column(at), b.column(len(columns)))]
            more = [pa.array([count_words(s) for s in cut], pa.list_(pa.int32()))] if counts else []
            yield pa.record_batch([*b.columns[:-1], pa.array(cut, pa.list_(pa.string())), *more], names=[*columns, "sentences", *["n_words"] * counts])

    schema = StructType([*docs.schema.fields, StructField("sentences", ArrayType(StringType())), *[StructField("n_words", ArrayType(IntegerType()))] * counts])
    return docs.join(cuts, key, "left").select(*columns, "_cuts").mapInArrow(run, schema)


def _sliced(text: bytes, cuts: list[int]) -> list[bytes]:
    """A text cut before the tokens of these numbers."""
    starts = _bounds(text)[0]
    if not len(starts):
        return []
    at = np.append(starts, len(text))[np.minimum([0, *cuts, len(starts)], len(starts))].tolist()
    return [text[a:z].rstrip() for a, z in zip(at, at[1:])]


#: The rules of the Penn Treebank tokeniser, in order, over a text with two spaces for white space: fixed values. \1 is the first group.
WORD_RULES = [
    (r'^(  )"', r"\1`` "), (r'([ (\[{<])"', r"\1 `` "), (r"\.\.\.", r" ... "), (r"([;@#$%&?!\]\[(){}<>])", r" \1 "), (r"([^.])(\.)([\])}>\"']*)\s*$", r"\1 \2\3 "), (r"--", r" -- "),
    (r"([:,])([^0-9])", r" \1 \2"), (r'"', r" '' "), (r"([^'])' ", r"\1 ' "), (r"([^' ])('[sSmMdD]) ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r" ([Cc]an)(not) ", r" \1 \2 "), (r" ([Dd])('ye) ", r" \1 \2 "), (r" ([Gg]im)(me) ", r" \1 \2 "), (r" ([Gg]on)(na) ", r" \1 \2 "), (r" ([Gg]ot)(ta) ", r" \1 \2 "), (r" ([Ll]em)(me) ", r" \1 \2 "),
    (r" ([Mm]or)('n) ", r" \1 \2 "), (r" ('[Tt])(is) ", r" \1 \2 "), (r" ('[Tt])(was) ", r" \1 \2 "), (r" ([Ww]an)(na) ", r" \1 \2 "),
]
#: The numbers of the rules that any text may meet, and the strings without which none of the others does anything.
OFTEN, RARE = (3, 4, 6), ("'", '"', "...", "--", "annot", "imme", "onna", "otta", "emme", "anna")


def words(text: Column) -> Column:
    """The words of a sentence, punctuation and clitics apart."""

    def chain(rules) -> Column:
        out = F.concat(F.lit("  "), F.regexp_replace(text, r"[\x09-\x0D\x20]+", "  "), F.lit("  "))
        for pattern, to in rules:
            out = F.regexp_replace(out, pattern, to.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))
        return out

    rare = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in RARE])
    out = F.when(rare, chain(WORD_RULES)).otherwise(chain([WORD_RULES[i] for i in OFTEN]))
    return F.filter(F.split(out, r"[\x09-\x0D\x20]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


_RULES = [(re.compile(pattern.encode(), re.ASCII), to.encode()) for pattern, to in WORD_RULES]
_RARE = [x.encode() for x in RARE]


def count_words(sentences: list[bytes]) -> list[int]:
    """How many words() each of a text's sentences (UTF-8) has, for a batch in a Python worker."""
    whole, out = b" ".join(sentences), []
    doubtful = [x for x in _RARE if x in whole]
    for s in sentences:
        t = b"  " + b"  ".join(s.split()) + b"  "
        for rule, to in _RULES if any(x in s for x in doubtful) else [_RULES[i] for i in OFTEN]:
            t = rule.sub(to, t)
        out.append(len(t.split()))
    return out
