import hashlib
from collections import defaultdict

import pytest

from memweave.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "<p>é" + "x" * 1000
ROWS = [
    (1, "http://a/", BIG, ""), (2, "http://a/ b\r\nInjected: 1", BIG, ""), (3, None, BIG, ""), (4, "http://c/", "small", ""), (5, "http://c/", "small", ""), (6, "", None, ""), (7, "u", "", ""), (None, "n", BIG, ""),
    (8, "u", "y" * 999, ""), (9, "u", "y" * 999, ""), (10, "u", "é" * 500, ""), (11, "u", "é" * 500, ""), (3, "twice", BIG, ""), (12, "u", "\r\n\r\n" + "z" * 1000, ""), (13, "u", "q" * 3_000_000, ""),
]


def brute(rows):
    groups = defaultdict(list)
    for i, _, html, _ in rows:
        groups[html or ""].append(i)
    out = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        top = max((x for x in groups[html or ""] if x is not None), default=None)
        again = len(body) >= 1000 and i != top
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    got = warc.warc(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)
    assert warc.warc(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_are_whole_and_payloads_stand_once(spark, tmp_path):
    path = f"{tmp_path}/a"
    warc.write(spark.createDataFrame(ROWS, SCHEMA), path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})
    records = [bytes(r.record) for r in warc.restore(spark, path).collect()]
    assert len(records) == len(ROWS)
    seen = {}
    for r in records:
        head, block = r.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and block.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block) - 4
        http, payload = block[:-4].split(b"\r\n\r\n", 1)
        said = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        if fields["WARC-Type"] == "response":
            assert said == len(payload) and fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        else:
            assert payload == b"" and fields["WARC-Refers-To"] and fields["WARC-Profile"] == warc.REVISIT
        assert "Injected" not in fields
        seen[fields.get("Source-Record")] = fields
    assert seen["2"]["WARC-Target-URI"] == "http://a/%20b%0D%0AInjected:%201" and "WARC-Target-URI" not in seen["6"] or seen["6"]["WARC-Target-URI"] == ""
    ids = {f["WARC-Record-ID"] for f in seen.values()}
    assert all(f["WARC-Refers-To"] in ids for f in seen.values() if f["WARC-Type"] == "revisit")
    parsed = warc.read(warc.restore(spark, path)).where("source = '12'").first()
    assert parsed.payload == b"\r\n\r\n" + b"z" * 1000 and parsed.target == "u"


def test_a_damaged_payload_is_found(spark, tmp_path):
    path = f"{tmp_path}/a"
    warc.write(spark.createDataFrame(ROWS[:4], SCHEMA), path)
    bodies = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "CASE WHEN octet_length(body) = 5 THEN CAST('smaLl' AS BINARY) ELSE body END AS body", "shard")
    bodies.write.partitionBy("shard").parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="not what its digest says"):
        warc.restore(spark, f"{tmp_path}/b").collect()


def test_payloads_are_deflated_where_they_are_shuffled(spark):
    bodies = [b"", b"\x00\xff" * 9, *(b"<td>%d</td>" % k * 3000 for k in range(300))]
    df = spark.createDataFrame([(hashlib.sha256(b).digest(), b) for b in bodies * 2], "digest binary, body binary").repartition(4)
    once = warc.distinct_payloads(df)
    assert sorted((bytes(r.digest), bytes(r.body)) for r in once.collect()) == sorted((hashlib.sha256(b).digest(), b) for b in bodies)
