"""What the corpus says of periods, against a version in plain Python."""

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from claimworks.operators import chunking
from claimworks.operators import sentences as s


def core(t):
    return t.strip(s.WRAPS)


def kind(c):
    if c.endswith(("!", "?")):
        return "m"
    if c.endswith(("..", "…")):
        return "e"
    if not c.endswith("."):
        return ""
    return "n" if re.match(s.NUMBER, c) else "i" if regex.match(r"^\p{L}\.$", c) else "p"


def typ(c):
    c = c.rstrip(".")
    return "#" if re.match(s.NUMBER, c) else c.lower()


def case(c):
    return "u" if regex.match(r"\p{Lu}", c) else "l" if regex.match(r"\p{Ll}", c) else "o"


def dunning(a, b, ab, n):
    log = lambda p: math.log(max(1e-12, p))
    part = lambda k, m, p: k * log(p) + (m - k) * log(1 - p)
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a) if n > a else 0
    return -2 * (part(ab, a, p) + part(b - ab, n - a, p) - part(ab, a, p1) - part(b - ab, n - a, p2))


def brute(texts):
    """Sentences of each text: token by token, with counts in dictionaries."""
    tokens = [[core(t) for t in re.findall(s.TOKEN, x)] for x in texts]
    n, withp = Counter(), Counter()
    for doc in tokens:
        for c in doc:
            n[typ(c)] += 1
            withp[typ(c)] += kind(c) in ("n", "i", "p")
    total, periods = sum(n.values()), sum(withp.values())
    short = set()
    for t, c in withp.items():
        if c and regex.search(r"\p{L}", t):
            p, inner = periods / total, t.count(".")
            letters = len(t) - inner
            log = lambda p: math.log(max(1e-12, p))
            ratio = -2 * (c * log(p) + (n[t] - c) * log(1 - p) - c * math.log(0.99) - (n[t] - c) * math.log(0.01))
            if ratio * math.exp(-letters) * (inner + 1) * letters ** float(c - n[t]) >= 0.3:
                short.add(t)
    seen, starts, breaks, together = defaultdict(set), Counter(), 0, Counter()
    for doc in tokens:
        for prev, c in zip([None, *doc], doc):
            k = "s" if prev is None else kind(prev)
            sure = k == "m" or k == "p" and typ(prev) not in short
            place = "beg" if sure or k == "s" else "mid" if k == "" else "unk"
            seen[typ(c)].add((case(c), place))
            breaks += sure
            starts[typ(c)] += sure and bool(regex.match(r"^\p{L}+$", typ(c)))
            if k in ("i", "n") or k == "p" and typ(prev) in short:
                together[typ(prev), typ(c)] += 1
    starter = {t for t, k in starts.items() if k and dunning(breaks, n[t], k, total) >= 30 and total * k > n[t] * breaks}
    tied = {(a, b) for (a, b), k in together.items() if b not in starter and dunning(n[a], n[b], k, total) >= 7.88 and total * k > n[a] * n[b]}

    def ends(prev, c):
        k, a, t = kind(prev), typ(prev), typ(c)
        if k == "":
            return False
        if k == "m":
            return True
        if (a, t) in tied:
            return False
        cases = seen[t]
        lower, upper = any(x == "l" for x, _ in cases), any(x == "u" for x, _ in cases)
        begins = case(c) == "u" and lower and ("u", "mid") not in cases
        runs_on = re.match(r"^[;:,.!?]*$", t) is not None or case(c) == "l" and (upper or ("l", "beg") not in cases)
        if k == "e" or a in short and k == "p":
            return not runs_on and begins or case(c) == "u" and t in starter
        if k in ("i", "n"):
            return not (a in short and k == "i" or runs_on or not begins and k == "i" and case(c) == "u" and not lower)
        return True

    out = []
    for text, doc in zip(texts, tokens):
        pieces = re.findall(s.TOKEN + r"[\x09-\x0D\x20]*", text)
        cut = [0] + [i for i in range(1, len(doc)) if ends(doc[i - 1], doc[i])]
        out.append([re.sub(r"[\x09-\x0D\x20]+$", "", "".join(pieces[a:b])) for a, b in zip(cut, [*cut[1:], len(doc)]) if pieces])
    return out


TEXTS = (
    ["Dr. Smith met Prof. Jones at 5 p.m. on 3. May. They talked (a lot). \"Really?\" she said. He left... Then J. R. Brown came. Köln etc. is far. E.g. this one."] * 8
    + ["The cat saw Dr. Miller. The dog, e.g. the big one, ran off! It was 3.5 km. No. 7 won. the end", "", " \n ", "One\n\ntwo.  three\tfour. Five", "Wait… what? yes.", "...", ". . .", "x" * 5000 + ". Y" + " z." * 2000]
)


def test_boundaries(spark, sf_dir):
    texts = TEXTS + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x")], "doc_id long, text string, tok string").repartition(3)
    got = {r.doc_id: r.sentences for r in s.sentences(df).collect()}
    assert got.pop(-1) == []
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert got[0][0].startswith("Dr. Smith met Prof. Jones at 5 p.m. on 3. May.") or len(got[0]) > 3
    assert s.sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ('They\'ll say "it\'s $5.50, isn\'t it?" (yes...)', ["They", "'ll", "say", "``", "it", "'s", "$", "5.50", ",", "is", "n't", "it", "?", "''", "(", "yes", "...", ")"]),
        ("I cannot go. Gimme that--now; don't.", ["I", "can", "not", "go.", "Gim", "me", "that", "--", "now", ";", "do", "n't", "."]),
        ("", []),
    ],
)
def test_words(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(s.words(F.col("t")).alias("w")).first().w == want


def test_packs(spark):
    """Whole sentences up to the limit, one that is longer alone."""
    df = spark.createDataFrame([([("a b", 2), ("c", 1), ("d e f g h", 5), ("i", 1), ("j k", 2)],)], "p array<struct<s string, n int>>")
    assert df.select(chunking.packs(F.col("p"), 3).alias("c")).first().c == ["a b c", "d e f g h", "i j k"]


def test_packs_keep_wordless(spark):
    """A sentence without words stays in its chunk; no sentences, no chunks."""
    df = spark.createDataFrame([([("-", 0), ("a", 1), ("b c", 2), ("d", 1)],), ([],)], "p array<struct<s string, n int>>")
    assert [r.c for r in df.select(chunking.packs(F.col("p"), 3).alias("c")).collect()] == [["- a b c", "d"], []]


def test_counts_before_exchange(spark):
    """Pairs are counted in the workers, in pieces of bounded size, and are what brute force finds; a token is cut out of its text once."""
    text = " ".join(f"(Word{i % 7}{'.' if i % 3 == 0 else ''}) «x…»" for i in range(400))
    pieces = list(s._met(iter([pa.record_batch([pa.array([text.encode()] * 5 + [b"", b" \n"])], names=["t"])]), most=10))
    assert all(len(x) <= 60 for x in pieces) and len(pieces) > 4
    want = Counter()
    toks = text.split()
    for prev, tok in zip([None, *toks], toks):
        want[prev if prev is None else core(prev) if any(m in prev for m in ".!?…") else "-", core(tok)] += 5
    got = Counter()
    for x in pieces:
        for r in x.to_pylist():
            got[r["p"], r["c"]] += r["k"]
    assert got == want


def test_counted_words(spark):
    """The count in the worker is that of the column expression, with rare and common rules, other white space, and cuts beyond the end."""
    texts = ["They'll say \"it's $5.50, isn't it?\" (yes...)", "I cannot\x0b go.\u2028 A, b:c 1,2. .", "Köln, ä:ö, e.", "x.)", ".", "a\xa0b."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(s.word_count(F.col("t")).alias("n")).collect()] == [s.count_words([t.encode()])[0] for t in texts]
    assert s._sliced(b"  a b.  c ", [2, 9]) == [b"a b.", b"c", b""]
