import base64
import hashlib
import uuid

from claimworks.llm import warc as w
from claimworks.llm._lineage import shared_folder


def brute(pages, least):
    out = []
    for i, url, html in pages:
        b = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == b]
        ids = [j for j in same if j is not None]
        first = min(ids) if ids else None
        again = len(b) >= least and len(same) > 1 and first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return out


PAGES = [
    (5, "http://a", "<p>é</p>"), (3, "http://b\r\nX: y", "<p>é</p>"), (9, None, None), (2, "u", ""), (7, "u", "x\r\n\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "x\r\n\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "u", "x\r\n\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>é</p>"), (None, "u", "only"), (11, "u", "z" * 300000), (12, "u", "z" * 300000), (-4, "u", "neg"), (13, "u", "neg"),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(4)
    for least in (0, 4):
        folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        w.write(df, folder, least=least)
        got = w.read(spark, folder).collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(brute(PAGES, least), key=str)
        assert sorted(bytes(r.payload) for r in got if r.payload is not None) == sorted((h or "").encode() for (_, _, h), x in zip(PAGES, brute(PAGES, least)) if x[3] == "response")


def test_empty_table(spark):
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    w.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert w.read(spark, folder).count() == 0
