import hashlib
import io
import zlib

import pytest

from tokenloom.llm import warc as W


def brute(rows):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        lead = first.get(h) if len(raw) >= 100 else None
        again = lead is not None and lead != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long = "<p>é " + "x" * 200 + "\r\n\r\n</p>"
    rows = [(i, f"http://h/{i % 3}", long if i % 3 == 0 else f"<b>{i}</b>" * (i % 40)) for i in range(10, 120)]
    rows += [(5, None, long), (6, "u", None), (7, "u", ""), (8, "u\r\nX: y", "short"), (9, "u", "short"), (300, "u", long), (300, "u", long), (None, "u", long), (5, None, long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = W.archive(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    texts = {r["page_id"]: r["html"] for r in got if r["record_type"] == "response"}
    assert texts[5] == long and texts[6] == "" and texts[10] == "<b>10</b>" * 10


def test_empty_table(spark):
    assert W.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_damage_is_found():
    digest = hashlib.sha256(b"abc").hexdigest()
    good = W.record(1, "u", b"abc", digest)
    assert W.read_record(next(W.members(io.BytesIO(good))))[:5] == (1, 3, digest, "response", None)
    assert len(list(W.members(io.BytesIO(good * 3)))) == 3
    with pytest.raises(ValueError):
        W.read_record(next(W.members(io.BytesIO(W.record(1, "u", b"abd", digest)))))
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(good[:-9])))
    plain = zlib.decompress(good, 31)
    with pytest.raises(ValueError):
        W.parse(plain[:-5] + b"\r\n\r\n")
